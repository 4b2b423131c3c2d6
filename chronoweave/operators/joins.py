"""Several inputs: synchronisation, element-wise arithmetic, and grids (extensions beyond the single-input operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ceil_div, floor_div
from ..model import StreamError
from .framing import check_period

OPERATIONS = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "ge": lambda a, b: F.when(a >= b, 1.0).otherwise(0.0),
}


def elementwise(left: DataFrame, right: DataFrame, operation: str) -> DataFrame:
    """t_ns and left op right for the times that both have: one equi-join on the grid time, which spreads by itself."""
    if operation not in OPERATIONS:
        raise StreamError("INVALID_CONFIG", f"no operation {operation}")
    a = left.select("t_ns", F.col("value").cast("double").alias("cw_a"))
    b = right.select("t_ns", F.col("value").cast("double").alias("cw_b"))
    return a.join(b, "t_ns").select("t_ns", OPERATIONS[operation](F.col("cw_a"), F.col("cw_b")).cast("float").alias("value"))


def time_window_sync(inputs: list[DataFrame]) -> DataFrame:
    """t_ns and value_0, value_1 and so on for the times that every input has."""
    out = None
    for i, df in enumerate(inputs):
        one = df.select("t_ns", F.col("value").alias(f"value_{i}"))
        out = one if out is None else out.join(one, "t_ns")
    return out


def skew_sync(inputs: list[DataFrame], frame_ns: int, max_skew_ns: int) -> DataFrame:
    """Frames that every input has, where the first times of the inputs differ by at most ``max_skew_ns``."""
    every = None
    for i, df in enumerate(inputs):
        one = df.select(F.lit(i).alias("cw_input"), "t_ns")
        every = one if every is None else every.unionByName(one)
    frame = floor_div(F.col("t_ns"), frame_ns).alias("frame")
    first = every.groupBy(frame, "cw_input").agg(F.min("t_ns").alias("t"))
    out = first.groupBy("frame").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("skew_ns"))
    return out.where((F.col("n") == len(inputs)) & (F.col("skew_ns") <= max_skew_ns)).select("frame", "skew_ns")


def sample_and_hold(left: DataFrame, right: DataFrame, segment_ns: int = 3_600_000_000_000) -> DataFrame:
    """Each left sample with the latest right value at or before its time.

    Times are cut into segments; each gets its right rows, and as a start the last right row of all earlier segments, taken from one
    row per segment.  So no task sees more than a segment.
    """
    cut = floor_div(F.col("t_ns"), segment_ns).alias("cw_segment")
    a = left.select("t_ns", "value", "seq", F.lit(1).alias("cw_left"), F.lit(None).cast("float").alias("cw_right"), cut)
    b = right.select("t_ns", F.lit(None).cast("float").alias("value"), "seq", F.lit(0).alias("cw_left"), F.col("value").cast("float").alias("cw_right"), cut)
    last = b.groupBy("cw_segment").agg(F.max_by("cw_right", F.struct("t_ns", "seq")).alias("cw_last"))
    segments = a.select("cw_segment").distinct().join(last, "cw_segment", "full")
    earlier = Window.orderBy("cw_segment").rowsBetween(Window.unboundedPreceding, -1)  # one row per segment
    starts = segments.select("cw_segment", F.last("cw_last", ignorenulls=True).over(earlier).alias("cw_start"))
    window = Window.partitionBy("cw_segment").orderBy("t_ns", "cw_left", "seq").rowsBetween(Window.unboundedPreceding, 0)
    held = a.unionByName(b).withColumn("cw_held", F.last("cw_right", ignorenulls=True).over(window)).where("cw_left = 1")
    return held.join(starts, "cw_segment").select("t_ns", "seq", "value", F.coalesce("cw_held", "cw_start").alias("held"))


def regularize(df: DataFrame, period_ns: int, method: str = "hold") -> DataFrame:
    """Each series on the grid of ``period_ns`` from its first to its last time, by the value before (hold) or on the line between neighbours.

    Every sample makes the grid times up to the next sample, so nothing is sorted beyond neighbours, and no series is one task.
    """
    check_period(period_ns)
    if method not in ("hold", "linear"):
        raise StreamError("INVALID_CONFIG", f"no method {method}")
    from .order import with_previous

    back = with_previous(df.select("series_id", "seq", "t_ns", "value"), {"was_t": "t_ns", "was": "value"})
    first = ceil_div(F.coalesce(F.col("was_t"), F.col("t_ns")), period_ns)
    # Grid times in [previous, this), and for the last one of a series its own time if it is on the grid.
    span = back.where(F.col("was_t").isNotNull()).select("series_id", "was_t", "t_ns", "was", "value", first.alias("k0"), ceil_div(F.col("t_ns"), period_ns).alias("k1"))
    grid = span.where("k1 > k0").select("series_id", "was_t", "t_ns", "was", "value", F.explode(F.sequence(F.col("k0"), F.col("k1") - 1)).alias("k"))
    at = F.col("k") * period_ns
    part = (at - F.col("was_t")) / (F.col("t_ns") - F.col("was_t"))
    line = F.col("was").cast("double") + (F.col("value").cast("double") - F.col("was").cast("double")) * part
    value = F.col("was").cast("double") if method == "hold" else line
    inner = grid.select("series_id", at.cast("long").alias("t_ns"), value.cast("float").alias("value"))
    ends = df.groupBy("series_id").agg(F.max_by(F.struct("t_ns", "value"), "seq").alias("e"))
    ends = ends.where(F.pmod(F.col("e.t_ns"), F.lit(period_ns)) == 0).select("series_id", F.col("e.t_ns").alias("t_ns"), F.col("e.value").cast("float").alias("value"))
    return inner.unionByName(ends)


def fill_gaps(df: DataFrame, period_ns: int) -> DataFrame:
    """Samples on a grid with missing grid times filled by the value before; ``filled`` tells which."""
    check_period(period_ns)
    from .order import with_previous

    ahead = with_previous(df.select("series_id", "seq", "t_ns", "value"), {"was_t": "t_ns", "was": "value"})
    gap = ahead.where(F.col("t_ns") - F.col("was_t") > period_ns)
    times = F.explode(F.sequence(F.col("was_t") + period_ns, F.col("t_ns") - 1, F.lit(period_ns).cast("long")))
    made = gap.select("series_id", times.alias("t"), "was").select("series_id", F.col("t").alias("t_ns"), F.col("was").alias("value"), F.lit(True).alias("filled"))
    return df.select("series_id", "t_ns", "value", F.lit(False).alias("filled")).unionByName(made)


def split_channels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wide rows (t_ns and a column per channel) as samples."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("series_id"), F.col(c).cast("float").alias("value")) for c in columns))).alias("p")
    return df.select("t_ns", pairs).select(F.col("p.series_id").alias("series_id"), "t_ns", F.col("p.value").alias("value"))


def combine_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """Samples as wide rows, a column for each of the given channels: one partially aggregated group per time."""
    return df.groupBy("t_ns").agg(*(F.max(F.when(F.col("series_id") == c, F.col("value"))).alias(c) for c in channels))
