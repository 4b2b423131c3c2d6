"""Waveform generator: column expressions over ``spark.range``, so samples are made where they are used."""

from __future__ import annotations

import math
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import StreamError

TURN = 2 * math.pi


class Waveform(Enum):
    SINE = "sine"
    SQUARE = "square"
    SAWTOOTH = "sawtooth"
    TRIANGLE = "triangle"


def _turn_part(angle: Column) -> Column:
    """The angle within one turn, 0 to 2 pi; the remainder of a negative angle is below zero first."""
    rest = angle % F.lit(TURN)
    return F.when(rest < 0, rest + TURN).otherwise(rest)


def unit_wave(kind: Waveform, angle: Column) -> Column:
    """The waveform between -1 and 1.  The sawtooth and the triangle begin at -1."""
    if kind is Waveform.SINE:
        return F.sin(angle)
    if kind is Waveform.SQUARE:
        return F.when(F.sin(angle) >= 0, 1.0).otherwise(-1.0)
    part = _turn_part(angle)
    if kind is Waveform.SAWTOOTH:
        return part * 2.0 / TURN - 1.0
    return F.when(part < math.pi, part * 2.0 / math.pi - 1.0).otherwise(3.0 - part * 2.0 / math.pi)


def signal_samples(
    spark: SparkSession,
    kind: Waveform,
    frequency_hz: float,
    period_ns: int,
    max_samples: int,
    amplitude: float = 1.0,
    phase: float = 0.0,
    offset: float = 0.0,
    start_ns: int = 0,
    series_id: str = "signal",
    allow_aliasing: bool = False,
) -> DataFrame:
    """``max_samples`` samples amplitude * wave(w * t + phase) + offset as floats; ``max_samples`` 0 is for streams only."""
    check_signal(kind, frequency_hz, period_ns, allow_aliasing)
    if max_samples <= 0:
        raise StreamError("INVALID_CONFIG", "an endless signal is a stream: see chronoweave.streaming.signal_stream")
    return with_signal(spark.range(max_samples), kind, frequency_hz, period_ns, amplitude, phase, offset, start_ns, series_id)


def check_signal(kind: Waveform, frequency_hz: float, period_ns: int, allow_aliasing: bool = False) -> None:
    if not isinstance(kind, Waveform):
        raise StreamError("INVALID_CONFIG", f"no waveform {kind}")
    if frequency_hz <= 0 or period_ns <= 0:
        raise StreamError("INVALID_CONFIG", "frequency and period have to be above zero")
    if not allow_aliasing and frequency_hz > 0.5e9 / period_ns:
        raise StreamError("INVALID_CONFIG", f"{frequency_hz} Hz is above half the sample rate")


def with_signal(ids: DataFrame, kind: Waveform, frequency_hz, period_ns, amplitude=1.0, phase=0.0, offset=0.0, start_ns=0, series_id="signal") -> DataFrame:
    """Samples for the numbers in column ``id`` of a batch or a stream."""
    t = F.lit(start_ns).cast("long") + F.col("id") * F.lit(period_ns).cast("long")
    speed = TURN * frequency_hz * 1e-9
    value = F.lit(float(amplitude)) * unit_wave(kind, t.cast("double") * F.lit(speed) + F.lit(float(phase))) + F.lit(float(offset))
    return ids.select(
        F.lit(series_id).alias("series_id"), F.col("id").alias("seq"), t.alias("t_ns"), F.lit(period_ns).cast("long").alias("period_ns"),
        value.cast("float").alias("value"),
    )
