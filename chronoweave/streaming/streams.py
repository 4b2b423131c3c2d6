"""Streams of samples.  Element-wise operators work on streams as they are; what keeps a state is here."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import floor_div
from ..operators.batching import RUNS, RunFold
from ..operators.elementwise import map_samples
from ..sources.signal import Waveform, check_signal, with_signal


def signal_stream(spark: SparkSession, kind: Waveform, frequency_hz: float, period_ns: int, rows_per_batch: int = 1024, **settings) -> DataFrame:
    """An endless signal: each micro-batch has ``rows_per_batch`` samples, whose values depend on their numbers only."""
    check_signal(kind, frequency_hz, period_ns, settings.pop("allow_aliasing", False))
    ids = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load().withColumnRenamed("value", "id")
    return with_signal(ids, kind, frequency_hz, period_ns, **settings)


def file_samples(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of samples as they arrive, so many at a time: the pull that takes the place of a blocking buffer."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def map_stream(stream: DataFrame, *functions: Callable) -> DataFrame:
    return map_samples(stream, *functions)


class RunProcessor(StatefulProcessor):
    """The run fold of one series.  Its state is the open batch; a row with null ``t_ns`` ends the series and closes it."""

    def __init__(self, capacity: int, detect: bool = True):
        self.capacity, self.detect = capacity, detect

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField(n, LongType()) for n in ("start", "n", "delta", "number")]
        self.state = handle.getValueState("open", StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        fold, number = RunFold(self.capacity, self.detect, tuple(int(x) for x in held[:3])), int(held[3])
        every = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for t in every["t_ns"]:
            closed = fold.close() if pd.isna(t) else fold.push(int(t))
            if closed:
                out.append((key[0], number, closed[0], closed[2], closed[1]))
                number += 1
        self.state.update((*fold.state, number))
        yield pd.DataFrame(out, columns=["series_id", "batch_id", "t_ns", "period_ns", "n"])

    def close(self) -> None:
        pass


def run_stream(stream: DataFrame, capacity: int = 64, detect: bool = True) -> DataFrame:
    """Closed batches of constant period of a stream (series_id, seq, t_ns); the open one waits in the state for more, or for the end."""
    rows = stream.select("series_id", "seq", "t_ns").groupBy("series_id")
    return rows.transformWithStateInPandas(RunProcessor(capacity, detect), RUNS, "append", "None")


def event_time_frames(stream: DataFrame, frame: str, late: str) -> DataFrame:
    """Counts and means of samples by event-time frame; samples that come later than ``late`` are dropped, and states with them."""
    at = F.timestamp_micros(floor_div(F.col("t_ns"), 1000))
    timed = stream.withColumn("at", at).withWatermark("at", late)
    out = timed.groupBy(F.window("at", frame), "series_id").agg(F.count("*").alias("n"), F.avg(F.col("value").cast("double")).alias("mean"))
    return out.select("series_id", (F.unix_micros("window.start") * 1000).alias("t_ns"), "n", "mean")


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """One query that hands each micro-batch to all sinks in turn, computed once."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _LoopReader(SimpleDataSourceStreamReader):
    """Numbers of the rows of a text that starts again at its end."""

    def __init__(self, lines: list[str], rows: int):
        self.lines, self.rows = lines, rows

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"at": start["at"] + self.rows}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([(i, self.lines[i % len(self.lines)]) for i in range(start["at"], end["at"])])

    def commit(self, end: dict) -> None:
        pass


class LoopedLines(DataSource):
    """Lines (option ``lines``, a JSON list) again and again, ``rows`` of them in each micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "looped_lines"

    def schema(self) -> StructType:
        return StructType([StructField("seq", LongType()), StructField("value", StringType())])

    def simpleStreamReader(self, schema: StructType) -> _LoopReader:  # noqa: N802
        return _LoopReader(json.loads(self.options["lines"]), int(self.options.get("rows", "100")))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]


def looped_source(spark: SparkSession, lines: list[str], rows: int = 100) -> DataFrame:
    """A stream (seq, value) of a short text's lines without an end."""
    spark.dataSource.register(LoopedLines)
    return spark.readStream.format("looped_lines").option("lines", json.dumps(lines)).option("rows", rows).load()
