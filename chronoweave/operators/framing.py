"""Frames on the epoch grid: the batch matcher and the sample aligner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import floor_div
from ..model import StreamError
from .order import constants, first_rows

#: How the first sample of a series finds the grid.
STRATEGIES = "nearest", "backward", "forward"
#: Accepted and kept, without an effect on values: samples are re-stamped, never interpolated.
METHODS = "nearest", "linear", "cubic", "sinc"
BOUNDARIES = "hold", "reflect", "zero"


def check_period(period_ns: int | None) -> int:
    if not period_ns or period_ns <= 0:
        raise StreamError("INVALID_CONFIG", "a known sample period above zero is needed")
    return period_ns


def grid_time(t_ns: Column, period_ns: int, strategy: str = "nearest") -> Column:
    """A time moved to a multiple of the period.

    ``nearest`` goes back if the phase is below half a period (by whole numbers), else forward; ``forward`` moves a time that is on the grid
    by a whole period.
    """
    if strategy not in STRATEGIES:
        raise StreamError("INVALID_CONFIG", f"no strategy {strategy}")
    phase = F.pmod(t_ns, F.lit(period_ns))
    back, on = t_ns - phase, t_ns + F.lit(period_ns) - phase
    if strategy == "nearest":
        return F.when(phase < period_ns // 2, back).otherwise(on)
    return back if strategy == "backward" else on


def align(df: DataFrame, period_ns: int, strategy: str = "nearest", method: str = "nearest", boundary: str = "hold") -> DataFrame:
    """Samples stamped base + seq * period, where base is the grid time of the series' first sample; values and order stay.

    The base is a partial aggregate joined back, so no series is sorted and a hot one can be split.
    """
    check_period(period_ns)
    if method not in METHODS or boundary not in BOUNDARIES:
        raise StreamError("INVALID_CONFIG", f"no method {method} or boundary {boundary}")
    base = first_rows(df, cw_t="t_ns", cw_seq="seq")
    base = base.select("series_id", grid_time(F.col("cw_t"), period_ns, strategy).alias("cw_base"), "cw_seq")
    out = df.join(base, "series_id")
    out = out.withColumn("t_ns", F.col("cw_base") + (F.col("seq") - F.col("cw_seq")) * period_ns).withColumn("period_ns", F.lit(period_ns).cast("long"))
    return out.select(*df.columns)


def align_regular(df: DataFrame, period_ns: int, strategy: str = "nearest") -> DataFrame:
    """The same for series whose times are regular and without gaps: each time is moved by the first one's correction."""
    check_period(period_ns)
    base = first_rows(df, cw_t="t_ns")
    base = base.select("series_id", (grid_time(F.col("cw_t"), period_ns, strategy) - F.col("cw_t")).alias("cw_shift"))
    return df.join(constants(base), "series_id").withColumn("t_ns", F.col("t_ns") + F.col("cw_shift")).select(*df.columns)


def align_stats(df: DataFrame, period_ns: int) -> DataFrame:
    """series_id, samples, and the phase of the first sample, which is the largest correction's measure."""
    check_period(period_ns)
    out = df.groupBy("series_id").agg(F.count("*").alias("samples"), F.min_by("t_ns", "seq").alias("cw_t"))
    return out.select("series_id", "samples", F.pmod(F.col("cw_t"), F.lit(period_ns)).alias("max_phase_ns"))


def frame_number(t_ns: Column, period_ns: int, size: int) -> Column:
    return floor_div(t_ns, period_ns * size)


def match_stamps(df: DataFrame, period_ns: int, size: int, emit_partial: bool = False) -> DataFrame:
    """Complete frames of ``size`` samples on the epoch grid: series_id, frame, t_ns, n, and sums of values; incomplete frames are dropped."""
    check_period(period_ns)
    out = df.groupBy("series_id", frame_number(F.col("t_ns"), period_ns, size).alias("frame")).agg(
        F.count("*").cast("int").alias("n"), F.min_by("value", "seq").alias("first_value"), F.max_by("value", "seq").alias("last_value")
    )
    out = out if emit_partial else out.where(F.col("n") == size)
    return out.select("series_id", "frame", (F.col("frame") * period_ns * size).alias("t_ns"), "n", "first_value", "last_value")


def match_frames(df: DataFrame, period_ns: int, size: int, emit_partial: bool = False) -> DataFrame:
    """Complete frames as batches with data in order of time.

    Counts come first, so that rows are gathered for frames of exactly ``size`` samples only, and a group never holds more.
    """
    check_period(period_ns)
    rows = df.withColumn("cw_frame", frame_number(F.col("t_ns"), period_ns, size))
    counts = rows.groupBy("series_id", "cw_frame").agg(F.count("*").alias("cw_n")).where(F.col("cw_n") <= size)
    whole = counts if emit_partial else counts.where(F.col("cw_n") == size)
    held = rows.join(whole, ["series_id", "cw_frame"]).groupBy("series_id", "cw_frame")
    out = held.agg(F.sort_array(F.collect_list(F.struct("t_ns", "seq", "value"))).alias("rows"))
    return out.select(
        "series_id", F.col("cw_frame").alias("batch_id"), (F.col("cw_frame") * period_ns * size).alias("t_ns"), F.lit(period_ns).cast("long").alias("period_ns"),
        F.size("rows").alias("n"), F.lit(0).alias("ec"), F.transform("rows", lambda r: r["value"]).alias("data"),
    )


def check_phase(df: DataFrame, period_ns: int) -> DataFrame:
    """The same rows; the first sample of a series that is off the grid raises PHASE_ERROR when rows are made."""
    check_period(period_ns)
    first = first_rows(df, cw_t="t_ns").where(F.pmod(F.col("cw_t"), F.lit(period_ns)) != 0).select(F.col("series_id").alias("cw_off"))
    out = df.join(first, F.col("series_id") == F.col("cw_off"), "left")
    bad = F.raise_error(F.concat(F.lit("PHASE_ERROR: first sample off the grid in series "), F.col("series_id")))
    return out.withColumn("t_ns", F.when(F.col("cw_off").isNotNull(), bad.cast("long")).otherwise(F.col("t_ns"))).select(*df.columns)


def match_stats(df: DataFrame, period_ns: int, size: int) -> DataFrame:
    """series_id, and samples processed, matched (in complete frames) and skipped."""
    frames = match_stamps(df, period_ns, size, emit_partial=True)
    matched = F.sum(F.when(F.col("n") == size, F.col("n")).otherwise(0))
    out = frames.groupBy("series_id").agg(F.sum("n").alias("processed"), matched.alias("matched"))
    return out.select("series_id", "processed", "matched", (F.col("processed") - F.col("matched")).alias("skipped"))
