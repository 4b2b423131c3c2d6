"""Order within series, without a task that holds a whole series.

A window over ``series_id`` alone sends a series to one task, and one series may be a third of all rows.  These helpers
cut each series into segments first and put results together from one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import floor_div

#: Time span of a segment when rows get their numbers, and rows of a segment when they look back.
SEGMENT_NS, SEGMENT_ROWS = 600_000_000_000, 65_536
#: Series whose constants are broadcast; of more they are joined.
BROADCAST_SERIES = 50_000


def with_seq(df: DataFrame, order: list[Column], segment_ns: int = SEGMENT_NS) -> DataFrame:
    """Adds ``seq``, 0 and up in each series, by ``t_ns`` and then ``order``.

    Rows are numbered within a series' time segments; segments start where the counts of earlier ones end.
    """
    cut = floor_div(F.col("t_ns"), segment_ns)
    rows = df.withColumn("cw_segment", cut)
    counts = rows.groupBy("series_id", "cw_segment").agg(F.count("*").alias("cw_n"))
    before = Window.partitionBy("series_id").orderBy("cw_segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("series_id", "cw_segment", F.coalesce(F.sum("cw_n").over(before), F.lit(0)).alias("cw_start"))
    place = F.row_number().over(Window.partitionBy("series_id", "cw_segment").orderBy("t_ns", *order))
    numbered = rows.withColumn("cw_place", place)
    out = numbered.join(starts, ["series_id", "cw_segment"])
    return out.withColumn("seq", (F.col("cw_start") + F.col("cw_place") - 1).cast("long")).drop("cw_segment", "cw_start", "cw_place")


def with_previous(df: DataFrame, columns: dict[str, str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds, under new names, values of the row before in its series (null for the first).

    Series are cut every ``segment_rows`` numbers of ``seq``; the last row of a segment is sent to the next one too.
    """
    segment = floor_div(F.col("seq"), segment_rows)
    last = F.pmod(F.col("seq"), F.lit(segment_rows)) == segment_rows - 1
    sent = df.withColumn("cw_segment", F.explode(F.when(last, F.array(segment, segment + 1)).otherwise(F.array(segment))))
    window = Window.partitionBy("series_id", "cw_segment").orderBy("seq")
    for name, source in columns.items():
        sent = sent.withColumn(name, F.lag(source).over(window))
    return sent.where(F.col("cw_segment") == segment).drop("cw_segment")


def first_rows(df: DataFrame, **values: str) -> DataFrame:
    """One row per series with values of its first row: a partially aggregated minimum, not a sort.

    The whole row is taken, so that a plan that joins the result back to ``df`` reads the same columns twice and shares its exchanges.
    """
    first = df.groupBy("series_id").agg(F.min_by(F.struct(*(c for c in df.columns if c != "series_id")), "seq").alias("cw_first"))
    return first.select("series_id", *(F.col(f"cw_first.{source}").alias(name) for name, source in values.items()))


def constants(base: DataFrame) -> DataFrame:
    """One row per series, to be joined to its samples: broadcast if there are few series, so that no sample is shuffled.

    The rows are made now, and at most ``BROADCAST_SERIES`` of them are kept; with more series, or in a stream, ``base`` is returned as it is.
    """
    if base.isStreaming:
        return base
    rows = base.limit(BROADCAST_SERIES + 1).collect()
    return base if len(rows) > BROADCAST_SERIES else F.broadcast(base.sparkSession.createDataFrame(rows, base.schema))
