"""Samples as delimited text."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import c_fixed, floor_div
from ..model import Dtype, StreamError

#: Rows whose sizes are added up in one window partition.
SIZE_PART = 65_536


class CsvFormat(Enum):
    SIMPLE = "simple"
    MULTI_COL = "multi_col"


def decimals(precision: int | None) -> int:
    """Decimals of a float: 6 unless a number above zero is given."""
    return precision if precision and precision > 0 else 6


def value_text(value: Column, dtype: Dtype, precision: int | None = None) -> Column:
    return c_fixed(value, decimals(precision)) if dtype is Dtype.FLOAT else value.cast("long").cast("string")


def header_line(fmt: CsvFormat = CsvFormat.SIMPLE, names: list[str | None] | None = None, delimiter: str = ",") -> str:
    """The names of the columns; a channel without a name is ``channel_`` and its number."""
    if fmt is CsvFormat.SIMPLE:
        return delimiter.join(["timestamp_ns", "value"])
    if not names:
        raise StreamError("INVALID_CONFIG", "columns are needed")
    return delimiter.join(["timestamp_ns", *(n or f"channel_{i}" for i, n in enumerate(names))])


def csv_lines(df: DataFrame, precision: int | None = None, dtype: Dtype = Dtype.FLOAT, delimiter: str = ",") -> DataFrame:
    """series_id, seq and line of every sample."""
    return df.select("series_id", "seq", F.concat_ws(delimiter, F.col("t_ns").cast("string"), value_text(F.col("value"), dtype, precision)).alias("line"))


def csv_frame(df: DataFrame, channels: list[str], precision: int | None = None, dtype: Dtype = Dtype.FLOAT, delimiter: str = ",") -> DataFrame:
    """t_ns and line of every time with a column for each channel (empty where it has no sample); a partial aggregate per time."""
    if not channels:
        raise StreamError("INVALID_CONFIG", "columns are needed")
    wide = df.groupBy("t_ns").agg(*(F.max(F.when(F.col("series_id") == c, F.col("value"))).alias(f"cw_{i}") for i, c in enumerate(channels)))
    cells = [F.coalesce(value_text(F.col(f"cw_{i}"), dtype, precision), F.lit("")) for i in range(len(channels))]
    return wide.select("t_ns", F.concat_ws(delimiter, F.col("t_ns").cast("string"), *cells).alias("line"))


def size_limited(lines: DataFrame, most_bytes: int, header: str | None = None, line_ending: str = "\n") -> DataFrame:
    """The lines of each series up to the one that reaches the limit, and ``end_bytes``, the size of its file after each.

    Sizes are added up within parts of ``SIZE_PART`` numbers; parts start at the sums of those before.  A limit of 0 keeps all.
    """
    start = len((header + line_ending).encode()) if header is not None else 0
    size = F.octet_length("line") + len(line_ending.encode())
    rows = lines.withColumn("cw_size", size).withColumn("cw_part", floor_div(F.col("seq"), SIZE_PART))
    sums = rows.groupBy("series_id", "cw_part").agg(F.sum("cw_size").alias("cw_sum"))
    before = Window.partitionBy("series_id").orderBy("cw_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("series_id", "cw_part", F.coalesce(F.sum("cw_sum").over(before), F.lit(0)).alias("cw_start"))
    running = F.sum("cw_size").over(Window.partitionBy("series_id", "cw_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("cw_running", running).join(starts, ["series_id", "cw_part"])
    out = out.withColumn("end_bytes", (F.lit(start) + F.col("cw_start") + F.col("cw_running")).cast("long"))
    if most_bytes:
        out = out.where(F.col("end_bytes") - F.col("cw_size") < most_bytes)
    return out.select("series_id", "seq", "line", "end_bytes")


def write_lines(lines: DataFrame, path: str, header: str | None = None, append: bool = False, order: tuple[str, ...] = ("series_id", "seq")) -> None:
    """Writes lines in order as text files, the header first; files come in the order of a range partitioning, not from one task."""
    text = lines.orderBy(*order).select(F.col("line").alias("value"))
    if header is not None:
        spark = lines.sparkSession
        text = spark.createDataFrame([(header,)], "value string").coalesce(1).union(text)
    text.write.mode("append" if append else "overwrite").text(path)
