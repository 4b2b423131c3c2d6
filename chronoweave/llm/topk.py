"""Exact top-k search by inner product, with no random access (NRA).

Vectors are quantised to integers.  A block of rows has a sorted list of (value, row) for each component.  For a query each list is read
sequentially from its best end (the end depends on the sign of the query's component), in rounds of growing depth; lists are read to depths in
proportion to the size of the query's component, because a list of small products bounds the scores tightly unread.  Partial sums are kept
of the rows that lists have shown.  In a list that has not shown it yet, a row lies between the list's worst value and the last
value read: that gives lower and upper bounds.  A row whose upper bound falls below the k-th largest lower bound of different ids, or below the k-th score
of blocks read before, cannot qualify; the sum of the last values read bounds all rows that no list has shown.  Reading stops when few rows
can still qualify; their final scores are then resolved.  A block whose best values do not reach the k-th score is not read at all.

The stated queries meet all rows in blocks: each task gets a block of queries and a stripe of row blocks, and holds one row block
at a time.  Row blocks are sent once for each block of ``QUERIES`` queries.  Sums are exact: in doubles while they stay below 2^53, in 64 bits below
2^63, and in Python integers beyond; a score among the best that does not fit a long is an error.

Defined cases: vectors null, empty or with null or non-finite components, and rows with a null vec_id, take no part; a row is not a
candidate of the query with its vec_id; rows that repeat a vec_id are one candidate with the best of their scores; ties go to the smaller vec_id; fewer candidates than k give fewer rows; the candidates of a
query are the vectors of its dimension; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Best, best_of_each, by_dimension, ranked, usable

#: Rows of a block, row blocks of a stripe, queries of a block.
ROWS, STRIPE, QUERIES = 4096, 4, 1024
#: Mean depths of the lists after each round, as parts of a block: for the first block, and with scores to beat.
DEPTHS, DEPTHS_WITH_BOUND = (0.6, 0.9, 1.3), (0.8, 1.3)


def quantised(vectors: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """The integers floor(scale * x): as doubles while these hold them, else as Python integers."""
    with np.errstate(over="ignore"):
        floors = np.floor(scale * vectors)
    if np.abs(floors).max(initial=0.0) < 2.0**52:
        return floors
    exact = [math.floor(f) if math.isfinite(f) else int(x) * int(scale) for f, x in zip(floors.ravel().tolist(), vectors.ravel().tolist(), strict=True)]
    return np.array(exact, object).reshape(vectors.shape)


def fitting(score: int, query: int) -> int:
    """The score, if it fits a long."""
    if not -(1 << 63) < score < 1 << 63:
        raise OverflowError(f"a score of query {query} does not fit a long")
    return int(score)


def _as(x: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers as another type; Python integers never by way of doubles."""
    return x.astype(np.int64).astype(object) if kind is object and x.dtype != object else x.astype(kind, copy=False)


class SortedBlock:
    """Rows of integers with their ids, and the sorted list of every component.  ``read`` counts the list entries read so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.read = ids, rows, 0
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.lists = np.take_along_axis(rows.T, self.order, axis=1)
        self.place = np.empty(self.order.shape, np.int16 if len(ids) < 1 << 15 else np.int32)
        np.put_along_axis(self.place, self.order, np.arange(len(ids), dtype=self.place.dtype)[None, :], axis=1)
        self.largest = int(np.abs(rows).max(initial=0))

    def _typed(self, query: np.ndarray) -> type:
        sums = self.largest * int(np.abs(query).max(initial=0)) * len(query)
        return np.float64 if sums < 1 << 53 else np.int64 if sums < 1 << 63 else object

    def best(self, query: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all rows that can be among those of the ``k`` best ids, given that only scores of at least ``least`` count."""
        kind, n = self._typed(query), len(self.ids)
        query = _as(query, kind)
        rising, used = query > 0, np.flatnonzero(query)
        alive = np.flatnonzero(self.ids != own)
        if len(alive) and len(used):
            first = query * _as(np.where(rising, self.lists[:, -1], self.lists[:, 0]), kind)
            if least is not None and first.sum() < least:
                alive = alive[:0]
            elif len(alive) > 4 * k:
                alive = self._qualified(query, rising, used, alive, first, k, least, kind)
        rows = _as(self.rows[alive], kind)
        scores = rows @ query if len(alive) else np.empty(0, kind)
        return self.ids[alive], scores.astype(np.int64) if kind is np.float64 else scores

    def _qualified(self, query, rising, used, alive, first, k, least, kind) -> np.ndarray:
        """Rows that can still qualify when reading stops."""
        n, weights = len(self.ids), np.abs(query).astype(np.float64)
        weights /= weights[used].mean()
        depth, known = np.zeros(len(query), np.int64), np.zeros(n, kind)
        worst = query * _as(np.where(rising, self.lists[:, 0], self.lists[:, -1]), kind)
        bound, falling = least, ~rising[:, None]
        for part in DEPTHS if least is None else DEPTHS_WITH_BOUND:
            wanted = np.minimum(n, np.ceil(part * n * weights)).astype(np.int64)
            more = used[wanted[used] > depth[used]]
            if not len(more):
                break
            for j in more:
                read = slice(n - wanted[j], n - depth[j]) if rising[j] else slice(depth[j], wanted[j])
                known[self.order[j, read]] += query[j] * _as(self.lists[j, read], kind)  # a list shows a row once
            self.read += int((wanted[more] - depth[more]).sum())
            depth = np.maximum(depth, wanted)
            edge = np.where(rising, n - depth, depth - 1).clip(0, n - 1)
            last = np.where(depth == 0, first, query * _as(self.lists[np.arange(len(query)), edge], kind))
            # Whether a list has shown a row: by the row's place in it.
            place = self.place if len(alive) == n else self.place[:, alive]
            unread = ((place < np.where(rising, n - depth, depth).astype(place.dtype)[:, None]) ^ falling).astype(kind)
            if least is None:
                low = np.sort(best_of_each(self.ids[alive], known[alive] + worst @ unread)[1])
                bound = low[len(low) - k] if len(low) > k else None
            if bound is not None:
                alive = alive[known[alive] + last @ unread >= bound]
            if len(alive) <= 4 * k:
                break
        return alive


def top_products(table: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score (integer inner product) of the ``k`` best candidates for each row of ``queries``."""
    spark = table.sparkSession
    base, asked = usable(table), usable(queries)
    n, asked_n = base.count(), asked.count()
    query_blocks = max(1, -(-asked_n // QUERIES))
    stripes = max(1, -(-n // (ROWS * STRIPE)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = TaskContext.get().partitionId() << 33, {}

        def block(d: int) -> pa.RecordBatch:
            nonlocal at
            ids, rows = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
            if len(ids) > ROWS:
                waiting[d] = [(ids[ROWS:], rows[ROWS:])]
            at += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([d], pa.int32()), pa.array([ids[:ROWS].tobytes()], pa.binary()), pa.array([rows[:ROWS].tobytes()], pa.binary())],
                ["at", "dim", "ids", "raw"],
            )

        for batch in batches:
            for d, ids, rows in by_dimension(batch):
                waiting.setdefault(d, []).append((ids, rows))
            while sum(len(ids) for parts in waiting.values() for ids, _ in parts) >= 2 * ROWS:
                yield block(max(waiting, key=lambda d: sum(len(ids) for ids, _ in waiting[d])))
        while waiting:
            yield block(next(iter(waiting)))

    packed = base.select("vec_id", "vector").mapInArrow(blocks, "at long, dim int, ids binary, raw binary")
    packed = packed.withColumn("stripe", F.pmod(F.xxhash64("at"), F.lit(stripes)).cast("int"))
    packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("kind", F.lit(1))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, ids, rows in by_dimension(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.full(len(ids), d, np.int32)), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["at", "dim", "ids", "raw"],
                )

    wanted = asked.select("vec_id", "vector").mapInArrow(coded, "at long, dim int, ids binary, raw binary")
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(query_blocks)).cast("int"))
    wanted = wanted.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("kind", F.lit(0))
    columns = "dim", "part", "stripe", "kind", "ids", "raw"
    met = wanted.select(*columns).unionByName(packed.select(*columns)).repartition("dim", "part", "stripe").sortWithinPartitions("dim", "part", "stripe", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked_ids, asked_rows, best, least = None, [], [], None, {}

        def result() -> pa.RecordBatch:
            query, vec, score = best.cut() if best else (np.empty(0, np.int64),) * 3
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score.tolist(), pa.int64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            kind = batch.column(3).to_pylist()
            for i, key in enumerate(keys):
                if key != now:
                    if now is not None:
                        yield result()
                    now, asked_ids, asked_rows, best, least = key, [], [], Best(k), {}
                ids = np.frombuffer(batch.column(4)[i].as_py(), np.int64)
                rows = quantised(np.frombuffer(batch.column(5)[i].as_py()).reshape(len(ids), -1), scale)
                if kind[i] == 0:
                    asked_ids += ids.tolist()
                    asked_rows += list(rows)
                    continue
                block = SortedBlock(ids, rows)
                for q, (own, vector) in enumerate(zip(asked_ids, asked_rows, strict=True)):
                    vec, score = block.best(vector, own, k, least.get(q))
                    vec, score = best_of_each(vec, score)  # before the cut: copies take no places
                    if score.dtype == object:
                        order = sorted(range(len(score)), key=lambda i: (-score[i], vec[i]))[:k]
                        score, vec = np.array([fitting(score[i], own) for i in order], np.int64), vec[order]
                    else:
                        order = np.lexsort((vec, -score))[:k]
                        vec, score = vec[order], score[order]
                    best.add(np.full(len(order), own), vec, score)
                    if len(order) == k:
                        least[q] = max(least.get(q, int(score[-1])), int(score[-1]))
        if now is not None:
            yield result()

    return ranked(met.mapInArrow(meet, "query_id long, vec_id long, score long"), k)
