"""Between samples and batches: views, reframing, and the detection of regular runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import floor_div
from ..model import StreamError


def sample_times(batches: DataFrame, data: str = "data") -> DataFrame:
    """One row per sample of batches (series_id, batch_id, t_ns, period_ns, data): sample i is at t_ns + i * period_ns."""
    out = batches.select("series_id", "batch_id", "t_ns", "period_ns", F.posexplode(data).alias("pos", "value"))
    return out.withColumn("t_ns", F.col("t_ns") + F.col("pos") * F.col("period_ns"))


def check_capacity(capacity: int) -> int:
    if capacity < 1 or capacity & (capacity - 1):
        raise StreamError("INVALID_CONFIG", f"batch capacity {capacity} is no power of two")
    return capacity


def frame_stamps(df: DataFrame, capacity: int) -> DataFrame:
    """Batches of ``capacity`` samples by ``seq``: number, time and period of the first sample, and count; no sort, one partial aggregate."""
    batch = batch_number(capacity).alias("batch_id")
    return df.groupBy("series_id", batch).agg(
        F.min_by("t_ns", "seq").alias("t_ns"), F.min_by("period_ns", "seq").alias("period_ns"), F.count("*").cast("int").alias("n")
    )


def to_batches(df: DataFrame, capacity: int) -> DataFrame:
    """The batch view: frames with their samples in an array.  A group holds at most ``capacity`` rows, as ``seq`` has no repeats."""
    batch = batch_number(capacity).alias("batch_id")
    rows = df.groupBy("series_id", batch).agg(F.sort_array(F.collect_list(F.struct("seq", "t_ns", "period_ns", "value"))).alias("rows"))
    return rows.select(
        "series_id", "batch_id", F.col("rows")[0]["t_ns"].alias("t_ns"), F.col("rows")[0]["period_ns"].alias("period_ns"),
        F.size("rows").alias("n"), F.lit(0).alias("ec"), F.transform("rows", lambda r: r["value"]).alias("data"),
    )


def runs_of(times: Iterator[int], capacity: int, detect: bool = True) -> Iterator[tuple[int, int, int]]:
    """Batches (first time, count, period) of a stream of times.

    A batch closes when it is full, or when a time is not exactly where the difference of the batch's first two times puts it; without
    detection after every sample.  The second sample sets the difference, whatever it is.  A single sample has period 0.
    """
    start = n = delta = 0
    for t in times:
        if n and (n >= capacity or not detect or (n > 1 and t != start + n * delta)):
            yield start, n, delta if n > 1 else 0
            n = 0
        if n == 0:
            start = t
        elif n == 1:
            delta = t - start
        n += 1
    if n:
        yield start, n, delta if n > 1 else 0


class RunFold:
    """The same as :func:`runs_of` one time at a time, with a state that can be kept: (start, n, delta)."""

    def __init__(self, capacity: int, detect: bool = True, state: tuple[int, int, int] = (0, 0, 0)):
        self.capacity, self.detect, self.state = capacity, detect, state

    def push(self, t: int) -> tuple[int, int, int] | None:
        """Takes a time; the batch that it closes, if any."""
        start, n, delta = self.state
        closed = None
        if n and (n >= self.capacity or not self.detect or (n > 1 and t != start + n * delta)):
            closed, n = (start, n, delta if n > 1 else 0), 0
        self.state = (t, 1, 0) if n == 0 else (start, n + 1, t - start if n == 1 else delta)
        return closed

    def close(self) -> tuple[int, int, int] | None:
        start, n, delta = self.state
        self.state = (0, 0, 0)
        return (start, n, delta if n > 1 else 0) if n else None


RUNS = "series_id string, batch_id long, t_ns long, period_ns long, n int"


def regular_batches(df: DataFrame, capacity: int = 64, detect: bool = True) -> DataFrame:
    """Batches of constant period found in each series, in order of ``seq``: series_id, batch_id, t_ns, period_ns, n.

    A batch's start depends on the start before it, so a series is folded in order.  Sorted partitions are streamed: a task holds an
    Arrow batch and three numbers, never a series.
    """
    check_capacity(capacity)
    rows = df.select("series_id", "seq", "t_ns").repartition("series_id").sortWithinPartitions("series_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, fold, number, out = None, None, 0, []

        def emit(batch: tuple[int, int, int] | None) -> None:
            nonlocal number
            if batch:
                out.append((series, number, batch[0], batch[2], batch[1]))
                number += 1

        def drained() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            out.clear()
            kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["series_id", "batch_id", "t_ns", "period_ns", "n"])

        for batch in batches:
            for s, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if fold is None or s != series:
                    if fold is not None:
                        emit(fold.close())
                    series, fold, number = s, RunFold(capacity, detect), 0
                emit(fold.push(t))
            yield drained()
        if fold is not None:
            emit(fold.close())
        yield drained()

    return rows.mapInArrow(run, RUNS)


def batch_number(capacity: int) -> Column:
    return floor_div(F.col("seq"), check_capacity(capacity))
