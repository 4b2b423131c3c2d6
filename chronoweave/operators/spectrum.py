"""Frequencies and levels of frames (extensions): power spectrum, signal-to-noise ratio, automatic scaling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def power_spectrum(batches: DataFrame) -> DataFrame:
    """series_id, batch_id, bin, frequency_hz and power of the frames of a batch view (period_ns above zero, equal lengths not needed).

    Each frame is transformed by itself in an Arrow batch; frames are bounded by their capacity.
    """
    schema = "series_id string, batch_id long, bin int, frequency_hz double, power double"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            series, number, bins, hz, power = [], [], [], [], []
            for s, b, period, data in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if not data:
                    continue
                p = np.abs(np.fft.rfft(np.array(data, np.float64))) ** 2 / len(data) ** 2
                p[1 : (len(data) + 1) // 2] *= 2
                series += [s] * len(p)
                number += [b] * len(p)
                bins += range(len(p))
                hz += (np.fft.rfftfreq(len(data), period * 1e-9)).tolist()
                power += p.tolist()
            columns = pa.array(series, pa.string()), pa.array(number, pa.int64()), pa.array(bins, pa.int32()), pa.array(hz, pa.float64()), pa.array(power, pa.float64())
            yield pa.RecordBatch.from_arrays(list(columns), ["series_id", "batch_id", "bin", "frequency_hz", "power"])

    return batches.where("period_ns > 0").select("series_id", "batch_id", "period_ns", "data").mapInArrow(run, schema)


def signal_to_noise(spectrum: DataFrame) -> DataFrame:
    """Of each frame the strongest frequency above zero, and its power over that of all others in decibels."""
    wave = spectrum.where("bin > 0")
    out = wave.groupBy("series_id", "batch_id").agg(F.max_by("frequency_hz", "power").alias("frequency_hz"), F.max("power").alias("cw_top"), F.sum("power").alias("cw_all"))
    rest = F.col("cw_all") - F.col("cw_top")
    ratio = F.when(rest > 0, 10 * F.log10(F.col("cw_top") / rest)).otherwise(F.lit(float("inf")))
    return out.select("series_id", "batch_id", "frequency_hz", ratio.alias("snr_db"))


def auto_scale(df: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Each series stretched to a range by its least and largest value, one partial aggregate joined back; a flat series gets the middle."""
    ends = df.groupBy("series_id").agg(F.min("value").cast("double").alias("cw_low"), F.max("value").cast("double").alias("cw_high"))
    part = (F.col("value").cast("double") - F.col("cw_low")) / F.when(F.col("cw_high") > F.col("cw_low"), F.col("cw_high") - F.col("cw_low"))
    value = F.lit(low) + F.coalesce(part, F.lit(0.5)) * F.lit(high - low)
    return df.join(ends, "series_id").withColumn("value", value.cast("float")).select(*df.columns)
