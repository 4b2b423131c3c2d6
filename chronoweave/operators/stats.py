"""Counters and signal statistics, one row per series.  Neighbours are found in segments, so a hot series is not one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import floor_div
from .order import with_previous


def counters(df: DataFrame, capacity: int) -> DataFrame:
    """Batches (of ``capacity`` samples) and samples of each series: the last number tells the batches, nothing is counted twice."""
    out = df.groupBy("series_id").agg(F.max("seq").alias("cw_last"), F.min("seq").alias("cw_first"), F.count("*").alias("samples_processed"))
    batches = floor_div(F.col("cw_last"), capacity) - floor_div(F.col("cw_first"), capacity) + 1
    return out.select("series_id", batches.cast("long").alias("n_batches"), "samples_processed")


def rms(df: DataFrame) -> DataFrame:
    x = F.col("value").cast("double")
    return df.groupBy("series_id").agg(F.sqrt(F.avg(x * x)).alias("rms"))


def zero_crossings(df: DataFrame, period_ns: int) -> DataFrame:
    """Sign changes of each series, and the frequency that they tell: half the changes over the time of all samples."""
    rows = with_previous(df.select("series_id", "seq", "value"), {"was": "value"})
    change = ((F.col("was") < 0) & (F.col("value") >= 0)) | ((F.col("was") >= 0) & (F.col("value") < 0))
    out = rows.groupBy("series_id").agg(F.sum(F.when(change, 1).otherwise(0)).alias("crossings"), F.count("*").alias("n"))
    return out.select("series_id", "crossings", (F.col("crossings") / 2.0 / (F.col("n") * period_ns / 1e9)).alias("frequency_hz"))


def sequence_errors(df: DataFrame, start: float = 0.0) -> DataFrame:
    """Samples that are not the series' start plus their number, and their first number."""
    wrong = F.col("value").cast("double") != F.lit(start) + F.col("seq")
    return df.groupBy("series_id").agg(F.sum(F.when(wrong, 1).otherwise(0)).alias("errors"), F.min(F.when(wrong, F.col("seq"))).alias("first_error"))


def timing_gaps(df: DataFrame, expected_ns: int, tolerance_ns: int = 1_000_000) -> DataFrame:
    """Samples whose distance from the one before differs from the expected one by more than the tolerance."""
    rows = with_previous(df.select("series_id", "seq", "t_ns"), {"was": "t_ns"})
    off = F.abs(F.col("t_ns") - F.col("was") - expected_ns) > tolerance_ns
    return rows.groupBy("series_id").agg(F.sum(F.when(off, 1).otherwise(0)).alias("gaps"), F.max(F.col("t_ns") - F.col("was")).alias("longest_ns"))


def latency(df: DataFrame) -> DataFrame:
    """Mean, least and largest distance of neighbours in nanoseconds."""
    rows = with_previous(df.select("series_id", "seq", "t_ns"), {"was": "t_ns"})
    d = F.col("t_ns") - F.col("was")
    return rows.groupBy("series_id").agg(F.avg(d).alias("avg_ns"), F.min(d).alias("min_ns"), F.max(d).alias("max_ns"))


def moving_average(df: DataFrame, width: int, segment_rows: int = 65_536) -> DataFrame:
    """Mean of a sample and the ``width`` - 1 before it (extension).  Each segment also gets the rows that it looks back on."""
    from pyspark.sql.window import Window

    segment = floor_div(F.col("seq"), segment_rows)
    reach = floor_div(F.col("seq") + width - 1, segment_rows)
    sent = df.withColumn("cw_segment", F.explode(F.sequence(segment, reach)))
    window = Window.partitionBy("series_id", "cw_segment").orderBy("seq").rowsBetween(-(width - 1), 0)
    out = sent.withColumn("average", F.avg(F.col("value").cast("double")).over(window))
    return out.where(F.col("cw_segment") == segment).drop("cw_segment")


def edges(df: DataFrame, level: float) -> DataFrame:
    """Samples at which a series comes to a level from below (extension)."""
    rows = with_previous(df, {"cw_was": "value"})
    return rows.where((F.col("cw_was") < level) & (F.col("value") >= level)).drop("cw_was")
