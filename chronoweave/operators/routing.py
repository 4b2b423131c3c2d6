"""Fan-out, routing, buffer policies and limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import floor_div
from ..model import BufferConfig, Overflow, StreamError


def tee(df: DataFrame, n: int, inputs: BufferConfig | None = None, outputs: list[BufferConfig] | None = None, keep: bool = False) -> list[DataFrame]:
    """``n`` (2 to 10) equal outputs.  With ``keep`` the input is persisted, which pays when its branches are costly to compute again."""
    if not 2 <= n <= 10:
        raise StreamError("INVALID_CONFIG", f"a tee has 2 to 10 outputs, not {n}")
    for out in outputs or []:
        if inputs and out.dtype != inputs.dtype:
            raise StreamError("TYPE_MISMATCH", "outputs of a tee have its input's type")
        if inputs and out.capacity != inputs.capacity:
            raise StreamError("CAPACITY_MISMATCH", "outputs of a tee have its input's batch capacity")
    source = df.persist() if keep else df
    return [source] * n


def tee_union(branches: list[DataFrame]) -> DataFrame:
    """Branches under each other with their number."""
    labelled = [b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)]
    out = labelled[0]
    for b in labelled[1:]:
        out = out.unionByName(b)
    return out


def write_counts(branches: list[DataFrame]) -> DataFrame:
    """branch and rows written to it."""
    return tee_union([b.select(F.lit(1).alias("one")) for b in branches]).groupBy("branch").agg(F.count("*").alias("written"))


def round_robin(df: DataFrame, n: int, number: str = "batch_id") -> list[DataFrame]:
    """Batch i goes to output i modulo ``n``."""
    return [df.where(F.pmod(F.col(number), F.lit(n)) == i) for i in range(n)]


def route(df: DataFrame, *conditions: Callable[[DataFrame], Column]) -> list[DataFrame]:
    """Rows for which each condition holds."""
    return [df.where(c(df)) for c in conditions]


def load_balance(df: DataFrame, n: int) -> list[DataFrame]:
    """Batches dealt by the hash of series and number, so that outputs get about equal parts whatever the pattern of numbers."""
    where = F.pmod(F.xxhash64("series_id", "batch_id"), F.lit(n))
    return [df.where(where == i) for i in range(n)]


def overflow(batches: DataFrame, config: BufferConfig, number: str = "batch_id") -> DataFrame:
    """What a buffer holds when all batches of a series come before the first is read: all (block), the first, or the last 2^n - 1."""
    if config.overflow is Overflow.BLOCK:
        return batches
    ends = batches.groupBy("series_id").agg(F.min(number).alias("cw_first"), F.max(number).alias("cw_last"))
    held = batches.join(ends, "series_id")
    inside = F.col(number) < F.col("cw_first") + config.slots if config.overflow is Overflow.DROP_HEAD else F.col(number) > F.col("cw_last") - config.slots
    return held.where(inside).select(*batches.columns)


def drop_stats(batches: DataFrame, config: BufferConfig) -> DataFrame:
    """series_id, batches, dropped, and the share dropped in percent."""
    n = F.count("*")
    lost = F.greatest(n - config.slots, F.lit(0)) if config.overflow is not Overflow.BLOCK else F.lit(0)
    out = batches.groupBy("series_id").agg(n.alias("batches"), lost.cast("long").alias("dropped"))
    return out.withColumn("drop_rate", 100.0 * F.col("dropped") / F.col("batches"))


def limit_samples(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` samples of each series (0: all)."""
    return df.where(F.col("seq") < most) if most else df


def overlap_batches(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """Samples dealt to batches of ``size`` of which each begins with the last ``overlap`` samples of the one before (extension)."""
    step = size - overlap
    if not 0 <= overlap < size:
        raise StreamError("INVALID_CONFIG", "the overlap is below the size")
    last = floor_div(F.col("seq"), step)
    first = F.greatest(F.lit(0).cast("long"), floor_div(F.col("seq") - size, step) + 1)
    out = df.withColumn("batch_id", F.explode(F.sequence(first, last)))
    return out.withColumn("pos", F.col("seq") - F.col("batch_id") * step)
