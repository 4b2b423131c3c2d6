"""Patterns for tests and pacing, user functions, and samples of the event table."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import floor_div
from ..model import StreamError
from ..operators.order import with_seq


class Pattern(Enum):
    SEQUENTIAL = "sequential"
    CONSTANT = "constant"
    SINE = "sine"
    RANDOM = "random"


def _samples(ids: DataFrame, period_ns: int, value: Column, start_ns: int = 0, series_id: str = "pattern") -> DataFrame:
    t = F.lit(start_ns).cast("long") + F.col("id") * F.lit(period_ns).cast("long")
    return ids.select(
        F.lit(series_id).alias("series_id"), F.col("id").alias("seq"), t.alias("t_ns"), F.lit(period_ns).cast("long").alias("period_ns"),
        value.cast("float").alias("value"),
    )


def pattern_samples(spark: SparkSession, pattern: Pattern, n: int, period_ns: int, constant: float = 0.0, start: float = 0.0, seed: int = 0) -> DataFrame:
    """``n`` samples of a pattern.  Random values are a hash of number and seed, so that they come out the same again."""
    noise = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    value = {
        Pattern.SEQUENTIAL: F.col("id") + F.lit(float(start)),
        Pattern.CONSTANT: F.lit(float(constant)),
        Pattern.SINE: F.sin(F.col("id").cast("double") * 0.1),
        Pattern.RANDOM: noise,
    }[pattern]
    return _samples(spark.range(n), period_ns, value)


def function_samples(spark: SparkSession, f: Callable[[Column], Column], n: int, rate_hz: int, series_id: str = "function") -> DataFrame:
    """``n`` samples of a column function of the sample number, at n * 1e9 / rate nanoseconds."""
    t = floor_div(F.col("id") * 1_000_000_000, rate_hz)
    return spark.range(n).select(
        F.lit(series_id).alias("series_id"), F.col("id").alias("seq"), t.alias("t_ns"), F.lit(1_000_000_000 // rate_hz).cast("long").alias("period_ns"),
        f(F.col("id")).cast("float").alias("value"),
    )


def variable_batches(spark: SparkSession, n: int, sizes: list[int], period_ns: int) -> DataFrame:
    """Samples with ``batch_id`` and ``pos`` of batches whose sizes go through a list again and again; arithmetic on the number only."""
    if not sizes or min(sizes) < 1:
        raise StreamError("INVALID_CONFIG", "batch sizes are 1 or more")
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    rest = F.pmod(F.col("seq"), F.lit(ends[-1]))
    inside, begin = F.lit(0), F.lit(0)
    for end in ends[:-1]:
        inside = inside + F.when(rest >= end, 1).otherwise(0)
        begin = F.when(rest >= end, end).otherwise(begin)
    out = _samples(spark.range(n), period_ns, F.col("id"))
    batch = floor_div(F.col("seq"), ends[-1]) * len(sizes) + inside
    return out.withColumn("batch_id", batch.cast("long")).withColumn("pos", (rest - begin).cast("int"))


def event_samples(events: DataFrame, series: str = "user_id") -> DataFrame:
    """The event table as samples: series by a column, nanoseconds from ``ts``, numbered by time and then event_id."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    rows = events.select(F.col(series).cast("string").alias("series_id"), t.alias("t_ns"), F.col("value").cast("float").alias("value"), "event_id")
    out = with_seq(rows, [F.col("event_id")])
    return out.select("series_id", "seq", "t_ns", F.lit(0).cast("long").alias("period_ns"), "value")
