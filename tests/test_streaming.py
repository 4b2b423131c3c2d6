"""Structured Streaming: results of a stream equal those of the same rows at once."""

import pytest

from chronoweave import operators as ops
from chronoweave.model import samples_schema
from chronoweave.sources import Waveform
from chronoweave.streaming import event_time_frames, fan_out, file_samples, looped_source, map_stream, run_stream, signal_stream

MS = 1_000_000


def run(stream, name, mode="append", tmp=None):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


@pytest.fixture
def folder(spark, tmp_path):
    for k, times in enumerate([[1, 2], [3, 8], [9]]):
        rows = [("a", sum([2, 2, 1][:k]) + i, t * MS, 0, float(t)) for i, t in enumerate(times)]
        spark.createDataFrame(rows, samples_schema()).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_map_of_a_stream(spark, folder, tmp_path):
    stream = map_stream(file_samples(spark, folder, samples_schema()), ops.scale(2), ops.offset(1))
    got = run(stream, "mapped", tmp=tmp_path / "c")
    assert sorted(x.value for x in got) == [3.0, 5.0, 7.0, 17.0, 19.0]


def test_runs_keep_the_open_batch_in_the_state(spark, folder, tmp_path):
    got = run(run_stream(file_samples(spark, folder, samples_schema(), files_per_trigger=100), 8), "runs", tmp=tmp_path / "c1")
    assert [(x.t_ns, x.n, x.period_ns) for x in got] == [(MS, 3, MS)]
    end = [("a", 99, None, 0, None)]
    spark.createDataFrame(end, samples_schema()).coalesce(1).write.mode("append").parquet(folder)
    got = run(run_stream(file_samples(spark, folder, samples_schema(), files_per_trigger=100), 8), "ended", tmp=tmp_path / "c2")
    assert sorted((x.t_ns, x.n, x.period_ns) for x in got) == [(MS, 3, MS), (8 * MS, 2, MS)]


def test_fan_out_and_frames(spark, folder, tmp_path):
    seen = [[], []]
    sinks = [lambda df, _n, k=k: seen[k].extend(x.value for x in df.collect()) for k in (0, 1)]
    fan_out(file_samples(spark, folder, samples_schema()), sinks, str(tmp_path / "f")).awaitTermination(120)
    assert sorted(seen[0]) == sorted(seen[1]) == [1.0, 2.0, 3.0, 8.0, 9.0]
    frames = event_time_frames(file_samples(spark, folder, samples_schema(), 100), "5 milliseconds", "0 seconds")
    got = run(frames, "frames", "complete", tmp_path / "w")
    assert sorted((x.t_ns, x.n, x.mean) for x in got) == [(0, 3, 2.0), (5 * MS, 2, 8.5)]


def test_endless_sources(spark, tmp_path):
    stream = signal_stream(spark, Waveform.SQUARE, 10.0, 1_000_000, rows_per_batch=50)
    q = stream.writeStream.format("memory").queryName("wave").option("checkpointLocation", str(tmp_path / "a")).start()
    while not q.recentProgress or spark.table("wave").count() < 50:
        q.awaitTermination(1)
    q.stop()
    assert {x.value for x in spark.table("wave").collect()} <= {1.0, -1.0}
    loop = looped_source(spark, ["1,1", "2,2"], rows=5)
    q = loop.writeStream.format("memory").queryName("loop").option("checkpointLocation", str(tmp_path / "b")).start()
    while spark.table("loop").count() < 10:
        q.awaitTermination(1)
    q.stop()
    assert [x.value for x in spark.table("loop").orderBy("seq").limit(5).collect()] == ["1,1", "2,2", "1,1", "2,2", "1,1"]
