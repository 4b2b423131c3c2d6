"""Batches as readable lines: a line of metadata, samples up to a limit, and a last line when the stream is complete."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import number_text
from ..model import Dtype


class DebugFormat(Enum):
    DECIMAL = "decimal"
    SCIENTIFIC = "scientific"
    HEX = "hex"
    BINARY = "binary"


def metadata_line(dtype: Dtype, prefix: str = "") -> Column:
    """The line of a batch row (t_ns, period_ns, n, ec)."""
    tail = F.when(F.col("ec") != 0, F.format_string(", ec=%d]", F.col("ec"))).otherwise("]")
    text = "[Batch t=%dns, period=%dns, samples=%d, type=" + dtype.name
    return F.concat(F.lit(prefix), F.format_string(text, F.col("t_ns"), F.col("period_ns"), F.col("n")), tail)


def debug_lines(
    batches: DataFrame, dtype: Dtype = Dtype.FLOAT, prefix: str = "", fmt: DebugFormat = DebugFormat.DECIMAL, most: int = 0,
    metadata: bool = True, samples: bool = True, completed: bool = False,
) -> DataFrame:
    """series_id, batch_id, line_no and line.  ``most`` samples of a batch are shown: 0 means 10, below zero all."""
    most = 10 if most == 0 else most
    shown = F.col("n") if most < 0 else F.least(F.col("n"), F.lit(most))
    out = None
    if metadata:
        out = batches.select("series_id", "batch_id", F.lit(-1).alias("line_no"), metadata_line(dtype, prefix).alias("line"))
    if samples:
        cells = batches.where("n > 0").select("series_id", "batch_id", F.posexplode(F.slice("data", F.lit(1), shown)).alias("line_no", "value"))
        text = F.concat(F.lit(f"{prefix}  ["), F.col("line_no").cast("string"), F.lit("] "), number_text(F.col("value"), dtype, fmt.value))
        one = cells.select("series_id", "batch_id", "line_no", text.alias("line"))
        rest = batches.where(F.col("n") > shown).select(
            "series_id", "batch_id", shown.cast("int").alias("line_no"), F.format_string(f"{prefix}  ... (%d more samples)", F.col("n") - shown).alias("line")
        )
        one = one.unionByName(rest)
        out = one if out is None else out.unionByName(one)
    if completed:
        last = batches.groupBy("series_id").agg((F.max("batch_id") + 1).alias("batch_id"))
        end = last.select("series_id", "batch_id", F.lit(0).alias("line_no"), F.lit(f"{prefix}[Stream completed]").alias("line"))
        out = end if out is None else out.unionByName(end)
    return out
