"""What the two vector searches share: usable vectors, blocks of rows, and the best few of each query.

Rows travel in blocks: one row of a block frame holds up to so many ids and the bytes of their matrix.  Pairs of blocks meet in a
join, and pairs of vectors only inside a task, so the frames have a row for each pair of blocks, not for each pair of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows whose vector is neither null nor empty nor holds null or non-finite components.

    Rows with a null vec_id take no part.  Rows that repeat a vec_id are one candidate, whose score is the best of them.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(finite, F.lit(False)))


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, ids and vectors of a batch's rows (id, vector), by dimension."""
    sizes = np.diff(batch.column(1).offsets.to_numpy()) if batch.num_rows else np.empty(0, np.int64)
    for d in np.unique(sizes):
        rows = batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))
        yield int(d), rows.column(0).to_numpy(), matrix(rows.column(1))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no digit, so that squares of very large or small components stay finite."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


class Best:
    """The ``k`` best (score, then smaller id) candidates of each query; rows are added in bulk and cut down beyond ``most``.

    If so many stay that half of that is taken, it is ``full``: the caller should pass them on by :meth:`take`.
    """

    def __init__(self, k: int, most: int = 400_000):
        self.k, self.most, self.parts, self.rows = k, most, [], 0

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, vec, score))
        self.rows += len(query)
        if self.rows > self.most:
            kept = self.cut()
            self.parts, self.rows = [kept], len(kept[0])

    @property
    def full(self) -> bool:
        return self.rows > self.most // 2

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What was kept; nothing is kept after that."""
        out = self.cut()
        self.parts, self.rows = [], 0
        return out

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, vec, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((-score, vec, query))
        query, vec, score = query[order], vec[order], score[order]
        fresh = np.append(True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])) if len(query) else np.empty(0, bool)
        query, vec, score = query[fresh], vec[fresh], score[fresh]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.append(True, query[1:] != query[:-1]) if len(query) else np.empty(0, bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else np.empty(0, np.int64)
        near = np.arange(len(query)) - begin < self.k
        return query[near], vec[near], score[near]


def best_of_each(vec: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and of each the best of its scores (the last axis is by row)."""
    order = np.argsort(vec, kind="stable")
    first = np.flatnonzero(np.append(True, vec[order][1:] != vec[order][:-1])) if len(vec) else np.empty(0, np.int64)
    if len(first) == len(vec):
        return vec, score
    return vec[order[first]], np.maximum.reduceat(score[..., order], first, axis=-1)


def top_rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a score matrix (queries by rows; -inf where a pair takes no part) the pairs that can be among a query's ``k`` best ids, ties included."""
    vec, score = best_of_each(vec, score)
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        q, v = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        # A tie at the last place may be wide: of equal scores the k smallest ids are enough.
        order = np.lexsort((vec[v], -score[q, v], q))
        q, v = q[order], v[order]
        first = np.append(True, q[1:] != q[:-1]) if len(q) else np.empty(0, bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.empty(0, np.int64)
        keep = np.arange(len(q)) - begin < k
        q, v = q[keep], v[keep]
    else:
        q, v = np.nonzero(score > -np.inf)
    return query[q], vec[v], score[q, v]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best rows; a window over a few rows for each query and task."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
