"""Delimited text in and out, generators, debug text: the known fixtures, re-created here."""

import math

import pytest
from pyspark.sql import functions as F

from chronoweave import operators as ops
from chronoweave.model import BufferConfig, Dtype, Overflow, StreamError
from chronoweave.sinks import CsvFormat, DebugFormat, buffer_summary, csv_frame, csv_lines, debug_lines, header_line, size_limited, write_lines
from chronoweave.sources import CsvSource, Pattern, Waveform, discover_header, pattern_samples, signal_samples, variable_batches


@pytest.fixture
def text(tmp_path):
    def write(body, name="in.csv"):
        path = tmp_path / name
        path.write_text(body)
        return str(path)

    return write


def values(df, series=None):
    rows = df.where(F.col("series_id") == series) if series else df
    return [(x.t_ns, x.value) for x in rows.orderBy("seq").collect()]


def test_end_to_end_scale(spark, text, tmp_path):
    body = "timestamp_ns,sensor1,sensor2,sensor3\n" + "".join(f"{10**9 + i * 10**6},{0.5 * i},{i},{2 * i}\n" for i in range(10))
    read = CsvSource(text(body), "timestamp_ns", ["sensor1"]).read(spark)
    lines = csv_lines(ops.map_samples(read, ops.scale(2.5)), precision=3)
    write_lines(lines, str(tmp_path / "out"), header_line())
    got = [x[0] for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(["timestamp_ns,value"] + [f"{10**9 + i * 10**6},{1.25 * i:.3f}" for i in range(10)])


def test_columns_by_name(spark, text):
    path = text("ts_ns,sensor1,sensor2,sensor3\n1000,1.5,2.5,3.5\n2000,4.5,5.5,6.5\n")
    got = CsvSource(path, "ts_ns", ["sensor1", "sensor3"]).read(spark)
    assert values(got, "sensor1") == [(1000, 1.5), (2000, 4.5)] and values(got, "sensor3") == [(1000, 3.5), (2000, 6.5)]
    with pytest.raises(StreamError, match="sensor9"):
        CsvSource(path, "ts_ns", ["sensor9"]).read(spark)


def test_several_files_are_read_in_order(spark, text, tmp_path):
    (tmp_path / "d").mkdir()
    text("ts,v\n1,10\n2,20\n", "d/a.csv")
    text("ts,v\n" + "".join(f"{i},{10 * i}\n" for i in range(3, 34)), "d/b.csv")
    text("ts,v\n", "d/c.csv")
    got = CsvSource(str(tmp_path / "d"), "ts", ["v"]).read(spark)
    assert [(x.seq, x.t_ns, x.value) for x in got.orderBy("seq").collect()] == [(i - 1, i, 10.0 * i) for i in range(1, 34)]
    twice = CsvSource(str(tmp_path / "d"), "ts", ["v"], loops=2).read(spark)
    assert [t for t, _ in values(twice)] == 2 * list(range(1, 34))
    text("v,ts\n7,7\n", "d/e.csv")
    with pytest.raises(Exception, match="INVALID_CONFIG: another header"):
        CsvSource(str(tmp_path / "d"), "ts", ["v"], skip_invalid=True).read(spark).collect()


def test_a_file_in_several_parts_keeps_its_order(spark, text):
    path = text("ts,v\n" + "".join(f"{i},{i}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = CsvSource(path, "ts", ["v"]).read(spark)
        assert [(x.seq, x.t_ns) for x in got.orderBy("seq").collect()] == [(i, i) for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("body", "kept"), [
    ("1000,1.0\n2000,bad\n3000,3.0\nbad,4.0\n5000,5.0\n", [1000, 3000, 5000]),
    ("1000,1.5 \n2000,1.5d\n3000,0x10\n4000,1e400\n5000,-1e3\n-6000,1\n7000,.5\n8000,nan\n9000,inf\n", [5000, 7000, 8000, 9000]),
    ("1000,1\n\n2000,2\n", [1000, 2000]),
    ('1000,"1"\n2000,2\n', [2000]),
])
def test_invalid_rows(spark, text, body, kept):
    path = text("ts_ns,value\n" + body)
    got = CsvSource(path, "ts_ns", ["value"], skip_invalid=True).read(spark)
    assert [t for t, _ in values(got)] == kept
    with pytest.raises(Exception, match="INVALID_DATA"):
        CsvSource(path, "ts_ns", ["value"]).read(spark).collect()


def test_unselected_cells_count_and_delimiters_merge(spark, text):
    path = text("ts,a,b\n1,2,x\n2,,3,4\n3,5\n4,6,7,8,9\n")
    got = CsvSource(path, "ts", ["a"], skip_invalid=True).read(spark)
    assert values(got) == [(2, 3.0), (3, 5.0), (4, 6.0)]
    assert values(CsvSource(path, "ts", ["b"], skip_invalid=True).read(spark)) == [(2, 4.0), (3, 0.0), (4, 7.0)]


def test_long_lines_and_empty_files(spark, text):
    path = text("ts_ns,value\n1000," + "1" * 4999 + "\n")
    with pytest.raises(Exception, match="line too long"):
        CsvSource(path, "ts_ns", ["value"], skip_invalid=True).read(spark).collect()
    assert CsvSource(text("ts_ns,value\n", "h.csv"), "ts_ns", ["value"]).read(spark).count() == 0
    with pytest.raises(StreamError):
        CsvSource(text("", "e.csv"), "ts_ns", ["value"]).read(spark)


def test_loops(spark, text):
    path = text("ts_ns,value\n1000,1\n2000,2\n")
    assert [v for _, v in values(CsvSource(path, "ts_ns", ["value"], loops=3).read(spark))] == [1, 2, 1, 2, 1, 2]


def test_source_settings(text):
    path = text("ts,v\n")
    for settings in ({"has_header": False}, {"capacities": [4, 8]}, {"loops": 0}, {"data_columns": []}, {"data_columns": [str(i) for i in range(65)]}):
        with pytest.raises(StreamError):
            CsvSource(**({"path": path, "ts_column": "ts", "data_columns": ["v"]} | settings))


def test_integer_types(spark, text):
    path = text("ts,v\n1,2.9\n2,-2.9\n")
    assert [v for _, v in values(CsvSource(path, "ts", ["v"], dtype=Dtype.I32).read(spark))] == [2, -2]


def test_regular_and_irregular_files(spark, text):
    irregular = [1000, 1001, 1002, 1003, 1004, 1006, 1006.5, 1007, 1008, 1009]
    body = "timestamp,value1,value2\n" + "\n".join(f"{int(t * 10**6)},{i},{i}" for i, t in enumerate(irregular))
    got = ops.regular_batches(CsvSource(text(body), "timestamp", ["value1"]).read(spark), 64).orderBy("batch_id").collect()
    assert [(x.t_ns, x.n, x.period_ns) for x in got] == [(1000 * 10**6, 5, 10**6), (1006 * 10**6, 3, 500_000), (1008 * 10**6, 2, 10**6)]


def test_header_discovery():
    assert discover_header(["time_ms", "a", "b"]) == ("time_ms", ["a", "b"])
    assert discover_header(["Time", "a", "timestamp_ns"]) == ("timestamp_ns", ["Time", "a"])
    with pytest.raises(StreamError):
        discover_header(["a", "b"])


def test_waveforms(spark):
    sine = signal_samples(spark, Waveform.SINE, 1000.0, 20833, 4800)
    assert ops.rms(sine).first().rms == pytest.approx(0.707, abs=0.01)
    assert ops.zero_crossings(sine, 20833).first().frequency_hz == pytest.approx(1000, abs=10)
    square = [v for _, v in values(signal_samples(spark, Waveform.SQUARE, 100.0, 100_000, 1000, amplitude=2, offset=0.5))]
    assert set(square) == {2.5, -1.5} and min(square.count(2.5), square.count(-1.5)) > 400
    saw = [v for _, v in values(signal_samples(spark, Waveform.SAWTOOTH, 100.0, 100_000, 128, phase=math.pi / 2))]
    assert saw[0] == pytest.approx(-0.5) and all(abs((b - a) - 0.02) < 1e-4 or b - a < -1.9 for a, b in zip(saw, saw[1:]))
    tri = [v for _, v in values(signal_samples(spark, Waveform.TRIANGLE, 250.0, 100_000, 400))]
    assert tri[0] == -1.0 and max(map(abs, tri)) <= 1.1


@pytest.mark.parametrize("settings", [
    {"frequency_hz": 6000.0}, {"frequency_hz": 0.0}, {"period_ns": 0}, {"kind": "noise"}, {"max_samples": 0},
])
def test_waveform_settings(spark, settings):
    with pytest.raises(StreamError, match="INVALID_CONFIG"):
        signal_samples(spark, **({"kind": Waveform.SINE, "frequency_hz": 100.0, "period_ns": 100_000, "max_samples": 10} | settings))
    assert signal_samples(spark, Waveform.SINE, 6000.0, 100_000, 3, allow_aliasing=True).count() == 3


def test_patterns(spark):
    noise = [v for _, v in values(pattern_samples(spark, Pattern.RANDOM, 100, 10, seed=3))]
    assert noise == [v for _, v in values(pattern_samples(spark, Pattern.RANDOM, 100, 10, seed=3))] and len(set(noise)) == 100
    sizes = variable_batches(spark, 114 * 2, [64, 32, 1, 17], 1000).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [x["count"] for x in sizes] == [64, 32, 1, 17] * 2
    with pytest.raises(StreamError):
        variable_batches(spark, 10, [], 1)


def test_size_limit(spark):
    df = spark.range(300).selectExpr("'a' series_id", "id seq", "id * 1000 t_ns", "0L period_ns", "cast(id as float) value")
    lines = csv_lines(df, precision=2)
    header = header_line()
    every = [x.line for x in lines.orderBy("seq").collect()]
    size, kept = len(header) + 1, 0
    for line in every:
        if size >= 1000:
            break
        size, kept = size + len(line) + 1, kept + 1
    got = size_limited(lines, 1000, header).orderBy("seq").collect()
    assert len(got) == kept and got[-1].end_bytes == size and 1000 <= size <= 1100
    assert size_limited(lines, 0).count() == 300


def test_multi_column(spark):
    df = spark.createDataFrame([("x", 0, 1, 0, 1.0), ("y", 0, 1, 0, 2.0), ("x", 1, 2, 0, 3.0)], "series_id string, seq long, t_ns long, period_ns long, value float")
    assert [x.line for x in csv_frame(df, ["x", "y"], 1).orderBy("t_ns").collect()] == ["1,1.0,2.0", "2,3.0,"]
    assert header_line(CsvFormat.MULTI_COL, ["x", None]) == "timestamp_ns,x,channel_1"
    with pytest.raises(StreamError):
        header_line(CsvFormat.MULTI_COL, [])
    assert csv_lines(df.withColumn("value", F.col("value").cast("int")), dtype=Dtype.I32).first().line == "1,1"


def test_append(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "l0")], "series_id string, seq long, line string")
    write_lines(df, str(tmp_path / "o"), "h")
    write_lines(df, str(tmp_path / "o"), append=True)
    assert sorted(x[0] for x in spark.read.text(str(tmp_path / "o")).collect()) == ["h", "l0", "l0"]


def test_debug_text(spark):
    batches = spark.createDataFrame(
        [("a", 0, 1000, 10, 3, 0, [1.0, -2.5, 3.0]), ("a", 1, 2000, 10, 0, 1, [])],
        "series_id string, batch_id long, t_ns long, period_ns long, n int, ec int, data array<float>",
    )
    lines = lambda **s: [x.line for x in debug_lines(batches, **s).orderBy("batch_id", "line_no").collect()]
    assert lines(prefix="> ", most=2, completed=True) == [
        "> [Batch t=1000ns, period=10ns, samples=3, type=FLOAT]", ">   [0] 1.000000", ">   [1] -2.500000", ">   ... (1 more samples)",
        "> [Batch t=2000ns, period=10ns, samples=0, type=FLOAT, ec=1]", "> [Stream completed]",
    ]
    assert lines(metadata=False, most=-1, fmt=DebugFormat.HEX) == ["  [0] 0x3F800000", "  [1] 0xC0200000", "  [2] 0x40400000"]
    assert lines(metadata=False, fmt=DebugFormat.SCIENTIFIC)[1] == "  [1] -2.500000e+00"
    assert lines(metadata=False, fmt=DebugFormat.BINARY)[0] == "  [0] 0b00111111100000000000000000000000"
    whole = batches.withColumn("data", F.col("data").cast("array<int>"))
    assert [x.line for x in debug_lines(whole, Dtype.I32, fmt=DebugFormat.HEX, metadata=False).orderBy("line_no").collect()][1] == "  [1] 0xFFFFFFFE"


def test_buffer_summary(spark):
    df = spark.range(32).selectExpr("'a' series_id", "id seq", "id t_ns", "0L period_ns", "cast(id as float) value")
    text = buffer_summary("in", BufferConfig(batch_expo=2, ring_expo=3, overflow=Overflow.DROP_TAIL), ops.frame_stamps(df, 4))
    assert "total 8, dropped 1, drop rate 12.5%" in text and "[0] a batch 1" in text
