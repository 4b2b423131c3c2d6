"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Each of ``TABLES`` hash tables projects vectors of length one on a few random orthogonal directions (a 2-stable family) and cuts each projection
into ``SLOTS`` slots, the outer ones open; a bucket is a combination of slots.  A query visits its own bucket and perturbed ones in the order of their estimated
chance to hold a neighbour: a neighbour at cosine c lies, in each direction, around c times the query's projection with variance 1 - c²,
so a bucket's chance is a product of normal masses.  Perturbations of the two halves of the directions are sorted each by itself, and a heap gives
their combinations, likeliest first, until their chances add up to ``CHANCE``; empty buckets are passed over.  The candidates of
all tables are merged and ranked by their exact cosine, in double precision on the original vectors.

There are ``TABLES`` * ``SLOTS`` ** ``DIRECTIONS`` buckets at most, whatever the number of vectors, so the directory of occupied ones that
queries are routed by is bounded.  A bucket is sent to tasks in
blocks of about ``BLOCK`` vectors, so a hot one is spread over many tasks.  In a task the queries of a block
meet its vectors as matrices.

Defined cases: vectors null, empty, of length zero, or with null or non-finite components, and rows with a null vec_id, take no part; a
vector is never its own neighbour (rows with the query's vec_id); rows that repeat a vec_id are one candidate with the best of their scores; ties go to the smaller vec_id; fewer candidates than k give fewer rows;
the candidates of a query are the vectors of its dimension; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Best, matrix, ranked, scaled, top_rows, usable

#: Hash tables, directions and slots of a direction, and width of the inner slots (in standard deviations of a projection).
TABLES, DIRECTIONS, SLOTS, WIDTH = 2, 8, 3, 1.2
#: Cosine that a neighbour is expected to have at least, and summed chance at which a query stops visiting a table's buckets.
COSINE, CHANCE = 0.4, 0.78
#: Vectors of one block of a bucket, and queries that meet them at once.
BLOCK, PART = 8192, 256


@dataclass
class Hashes:
    """The random directions and the borders of the slots of all tables, for one dimension."""

    directions: np.ndarray  # tables x dimension x directions
    borders: np.ndarray  # tables x directions x (slots - 1)

    @classmethod
    def make(cls, dimension: int, tables: int = TABLES, directions: int = DIRECTIONS, slots: int = SLOTS, seed: int = 7) -> Hashes:
        random = np.random.default_rng(seed)
        k = min(directions, dimension)
        a = np.stack([np.linalg.qr(random.standard_normal((dimension, k)))[0] for _ in range(tables)])
        offsets = random.uniform(-WIDTH / 4, WIDTH / 4, (tables, k, 1))
        return cls(a * np.sqrt(dimension), (np.arange(slots - 1) - (slots - 2) / 2) * WIDTH + offsets)

    @property
    def buckets(self) -> int:
        """Buckets of a table."""
        return (self.borders.shape[2] + 1) ** self.borders.shape[1]

    def projections(self, unit: np.ndarray) -> np.ndarray:
        """tables x vectors x directions."""
        return np.einsum("nd,tdk->tnk", unit, self.directions)

    def codes(self, projections: np.ndarray) -> np.ndarray:
        """Bucket numbers, tables x vectors; those of table t begin at t * ``buckets``."""
        slots = (projections[..., None] > self.borders[:, None]).sum(axis=3)
        weights = (self.borders.shape[2] + 1) ** np.arange(slots.shape[2], dtype=np.int64)
        return slots @ weights + np.arange(len(slots), dtype=np.int64)[:, None] * self.buckets


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-4."""
    t = np.abs(x) / np.sqrt(2)
    e = 1 / (1 + t * (0.278393 + t * (0.230389 + t * (0.000972 + t * 0.078108)))) ** 4
    return np.where(x < 0, e / 2, 1 - e / 2)


def slot_chances(projections: np.ndarray, borders: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Of queries (rows of projections on one table's directions) the chance of a neighbour to be in each slot: queries x directions x slots."""
    below = _phi((borders[None] - cosine * projections[:, :, None]) / np.sqrt(1 - cosine**2))
    edge = np.ones((*below.shape[:2], 1))
    return np.diff(np.concatenate([0 * edge, below, edge], axis=2), axis=2)


def probes(chances: np.ndarray, chance: float = CHANCE) -> Iterator[int]:
    """Buckets (numbers in their table) by falling chance, given those of each direction's slots, until they add up to ``chance``."""
    k, slots = chances.shape
    halves = []
    for directions in (range(k // 2), range(k // 2, k)):
        p, code = np.ones(1), np.zeros(1, np.int64)
        for d in directions:
            p = (p[:, None] * chances[d]).ravel()
            code = (code[:, None] + np.arange(slots) * slots**d).ravel()
        order = np.argsort(-p, kind="stable")
        halves.append((p[order].tolist(), code[order].tolist()))
    (p, own), (q, other) = halves
    heap, total = [(-p[0] * q[0], 0, 0)], 0.0
    while heap and total < chance:
        likely, i, j = heapq.heappop(heap)
        total -= likely
        yield own[i] + other[j]
        if j + 1 < len(q):
            heapq.heappush(heap, (-p[i] * q[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(p):
            heapq.heappush(heap, (-p[i + 1] * q[0], i + 1, 0))


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, chance: float = CHANCE, cosine: float = COSINE) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the ``k`` nearest candidates found among ``table`` for each row of ``queries``.

    Both have vec_id and embedding.  Shuffled are each vector once for each table, and each query once for each block of vectors that it visits.
    """
    base, asked = usable(table).where("exists(vector, x -> x <> 0)"), usable(queries).where("exists(vector, x -> x <> 0)")
    sizes = sorted(r.d for r in base.select(F.size("vector").alias("d")).distinct().collect())
    if not sizes:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of = lambda df, d: df.where(F.size("vector") == d)
    return ranked(reduce(DataFrame.unionByName, (_candidates(of(base, d), of(asked, d), d, k, tables, chance, cosine) for d in sizes)), k)


def _candidates(base: DataFrame, asked: DataFrame, dimension: int, k: int, tables: int, chance: float, cosine: float) -> DataFrame:
    """query_id, vec_id and score of the best candidates that each task finds, for vectors of one dimension."""
    spark = base.sparkSession
    hashes = spark.sparkContext.broadcast(Hashes.make(dimension, tables))

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def codes(v: np.ndarray) -> np.ndarray:
        return hashes.value.codes(hashes.value.projections(unit(v)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, n = np.unique(codes(scaled(matrix(batch.column(0)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    counted = base.select("vector").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    blocks = np.zeros(tables * hashes.value.buckets, np.int64)
    blocks[counted.column("code").to_numpy()] = -(-counted.column("n").to_numpy() // BLOCK)
    shared = spark.sparkContext.broadcast((blocks, np.concatenate(([0], np.cumsum(blocks)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, first_block = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = scaled(matrix(batch.column(1))), batch.column(0).to_numpy()
            at = codes(v)
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = first_block[at] + (salt[None, :] % blocks[at].astype(np.uint64)).astype(np.int64)
            raw = [x.tobytes() for x in v]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ravel()), pa.array(np.tile(ids, tables)), pa.array(raw * tables, pa.binary())], ["block", "id", "raw"]
            )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, first_block = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = scaled(matrix(batch.column(1))), batch.column(0).to_numpy()
            projections = hashes.value.projections(unit(v))
            raw = [x.tobytes() for x in v]
            for t in range(tables):
                for q, chances in enumerate(slot_chances(projections[t], hashes.value.borders[t], cosine)):
                    at = np.fromiter(probes(chances, chance), np.int64) + t * hashes.value.buckets
                    at = at[blocks[at] > 0]
                    n = blocks[at]
                    block = np.repeat(first_block[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block), pa.array(np.full(len(block), ids[q])), pa.array([raw[q]] * len(block), pa.binary())], ["block", "id", "raw"]
                    )

    schema = "block long, id long, raw binary"
    rows = base.select("vec_id", "vector").mapInArrow(place, schema).withColumn("is_query", F.lit(0))
    sent = asked.select("vec_id", "vector").mapInArrow(route, schema).withColumn("is_query", F.lit(1))
    # A block's vectors come before its queries, and its queries are met a part at a time.
    met = rows.unionByName(sent).repartition("block").sortWithinPartitions("block", "is_query")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        now, vec_ids, vec_raw = None, [], []
        ready: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in best.take()], ["query_id", "vec_id", "score"])

        def ask(ids: np.ndarray, raw: list[bytes]) -> None:
            nonlocal ready
            if not vec_ids:
                return
            if ready is None:
                m = np.frombuffer(b"".join(vec_raw)).reshape(len(vec_raw), -1)
                ready = np.array(vec_ids), m, np.sqrt(np.einsum("ij,ij->i", m, m))
            for i in range(0, len(ids), PART):
                q = np.frombuffer(b"".join(raw[i : i + PART])).reshape(-1, ready[1].shape[1])
                score = np.einsum("ij,kj->ik", q, ready[1]) / (np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * ready[2][None, :])
                score[ids[i : i + PART, None] == ready[0][None, :]] = -np.inf
                best.add(*top_rows(ids[i : i + PART], ready[0], score, k))

        for batch in batches:
            block, ids, kind = (batch.column(i).to_numpy() for i in (0, 1, 3))
            raw = batch.column(2).to_pylist()
            cuts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
                if block[lo] != now:
                    now, vec_ids, vec_raw, ready = block[lo], [], [], None
                if kind[lo] == 0:
                    vec_ids += ids[lo:hi].tolist()
                    vec_raw += raw[lo:hi]
                else:
                    ask(ids[lo:hi], raw[lo:hi])
                    if best.full:
                        yield found()
        yield found()

    return met.mapInArrow(meet, "query_id long, vec_id long, score double")
