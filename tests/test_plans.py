"""Contracts, connections and pipelines."""

import pytest
from pyspark.sql import functions as F

from chronoweave import operators as ops
from chronoweave.model import BufferConfig, Dtype, ErrorCode, StreamError
from chronoweave.plans import Constraint, Contract, Filter, Pipeline, Properties, check_alignment, check_connection, connect, from_buffer, period_to_rate_hz, propagate, rate_to_period_ns
from chronoweave.plans.filters import (
    Health, batch_matcher, csv_sink, csv_source, debug_output, map_filter, passthrough_filter, sample_aligner, signal_generator, tee_filter,
)
from chronoweave.sources import CsvSource, Waveform

WAVE = {"kind": Waveform.SINE, "frequency_hz": 10.0, "period_ns": 10_000_000, "max_samples": 100}


@pytest.mark.parametrize(("op", "operand", "known", "message"), [
    ("exists", None, None, "Required property 'sample_period_ns' is not present"),
    ("exists", None, 5, None),
    ("eq", 5, None, "Property 'sample_period_ns' is not present but must equal specific value"),
    ("eq", 5, 6, "Property 'sample_period_ns' mismatch: expected 5, got 6"),
    ("gte", 5, 4, "Property 'sample_period_ns' (4) is less than required minimum (5)"),
    ("gte", 5, None, "Property 'sample_period_ns' is not present but must be >= 5"),
    ("gte", 5, 5, None),
    ("lte", 5, 6, "Property 'sample_period_ns' (6) is greater than required maximum (5)"),
    ("lte", 5, None, "Property 'sample_period_ns' is not present but must be <= 5"),
    ("lte", 5, 5, None),
])
def test_constraints(op, operand, known, message):
    contract = Contract().require("sample_period_ns", op, operand)
    if message is None:
        check_connection(Properties(sample_period_ns=known), contract)
    else:
        with pytest.raises(StreamError) as e:
            check_connection(Properties(sample_period_ns=known), contract)
        assert e.value.code is ErrorCode.PROPERTY_MISMATCH and e.value.message == message


def test_types_ports_and_bad_names():
    contract = Contract().require("data_type", "eq", Dtype.FLOAT, ports=[1])
    check_connection(Properties(), contract, 0)
    with pytest.raises(StreamError, match="Data type mismatch: expected 1, got 2"):
        check_connection(Properties(data_type=Dtype.I32), contract, 1)
    with pytest.raises(StreamError):
        Constraint("colour", "exists")
    with pytest.raises(StreamError):
        Constraint("data_type", "eq")


def test_alignment():
    contract = Contract().require("sample_period_ns", "aligned", ports=[0, 1])
    check_alignment(contract, {}, 0, Properties(sample_period_ns=5))
    check_alignment(contract, {0: Properties(sample_period_ns=5)}, 1, Properties(sample_period_ns=5))
    check_alignment(contract, {0: Properties(sample_period_ns=5)}, 2, Properties())
    for inputs, new, text in (
        ({0: Properties(sample_period_ns=5)}, Properties(sample_period_ns=6), "sample period mismatch between port 1 \\(6 ns\\) and port 0 \\(5 ns\\)"),
        ({0: Properties()}, Properties(sample_period_ns=6), "not known in existing input \\(port 0\\)"),
        ({}, Properties(), "not known in new input \\(port 1\\)"),
    ):
        with pytest.raises(StreamError, match=text):
            check_alignment(contract, inputs, 1, new)


def test_propagation_and_limits():
    contract = Contract().promise("data_type", "preserve", source=7).promise("max_batch_capacity", "set", 64)
    out = propagate([Properties(data_type=Dtype.I32, sample_period_ns=9)], contract)
    assert out == Properties(data_type=Dtype.I32, sample_period_ns=9, max_batch_capacity=64)
    assert propagate([], contract) == Properties(max_batch_capacity=64)
    with pytest.raises(StreamError):
        contract.promise("data_type", "set", Dtype.FLOAT)
    full = Contract()
    for _ in range(16):
        full.require("data_type", "exists")
    with pytest.raises(StreamError):
        full.require("data_type", "exists")
    assert from_buffer(BufferConfig()).describe().splitlines() == ["Property Table:", "  data_type: 1", "  min_batch_capacity: 64", "  max_batch_capacity: 64"]
    assert (rate_to_period_ns(48_000), period_to_rate_hz(20_833), rate_to_period_ns(0), period_to_rate_hz(0)) == (20833, 48000, 0, 0)
    assert Properties(max_total_samples=2**40).max_total_samples == 2**40


def test_checked_and_unchecked_connections(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("ts,v\n1,2\n2,4\n")
    source = csv_source(spark, "in", CsvSource(str(path), "ts", ["v"]))
    with pytest.raises(StreamError, match="PROPERTY_MISMATCH"):  # batches of unknown size do not fit
        connect(source, 0, map_filter("m", ops.scale(2)))
    with pytest.raises(StreamError, match="sample_period_ns"):
        connect(source, 0, csv_sink("s", lambda df: df))
    m = map_filter("m", ops.scale(2))
    connect(source, 0, m, checked=False)
    assert sorted(x.value for x in m.frames()[0].collect()) == [4.0, 8.0]
    with pytest.raises(StreamError, match="CONNECTION_OCCUPIED"):
        source.sink_connect(0, map_filter("n"))
    with pytest.raises(StreamError, match="INVALID_SINK_IDX"):
        source.sink_connect(5, map_filter("n"))
    source.sink_disconnect(0)
    with pytest.raises(StreamError, match="NO_SINK"):
        source.sink_disconnect(0)


def test_types_have_to_match():
    with pytest.raises(StreamError, match="DTYPE_MISMATCH"):
        passthrough_filter("a").sink_connect(0, passthrough_filter("b", BufferConfig(Dtype.I32)))


def test_lifecycle():
    f = passthrough_filter("p" * 50)
    assert len(f.name) == 31 and f.health() is Health.HEALTHY and f.backlog() == 0
    f.start()
    with pytest.raises(StreamError, match="ALREADY_RUNNING"):
        f.start()
    f.stop()
    f.handle_error(ErrorCode.TIMEOUT)
    assert f.health() is Health.FAILED and "TIMEOUT" in f.dump_state()
    f.recover()
    assert f.health() is Health.HEALTHY
    with pytest.raises(StreamError, match="NOT_IMPLEMENTED"):
        f.reconfigure(a=1)
    for settings in ({"n_inputs": 11}, {"n_outputs": 11}, {"timeout_us": -1}):
        with pytest.raises(StreamError):
            Filter("x", lambda: None, **settings)
    with pytest.raises(StreamError, match="INVALID_CONFIG_WORKER"):
        Filter("x", None)
    with pytest.raises(StreamError, match="NOINPUT"):
        f.frames()
    for call in (f.flush, f.drain, f.reset, f.deinit):
        call()


def test_pipeline_scales_and_offsets(spark):
    source, a, b = signal_generator(spark, "gen", **WAVE), map_filter("double", ops.scale(2)), map_filter("plus", ops.offset(10))
    inner = Pipeline("inner", [a, b], [(a, 0, b, 0)], (a, 0), (b, 0))
    connect(source, 0, inner)
    rows = inner.frames()[0].orderBy("seq").collect()
    plain = source.frames()[0].orderBy("seq").collect()
    assert [x.value for x in rows] == pytest.approx([2 * x.value + 10 for x in plain], abs=0.01)
    inner.start()
    assert a.running and b.running
    inner.stop()
    assert not a.running and "double[0] -> plus[0]" in inner.describe()


def test_diamond_runs_once_and_validates(spark):
    buffer = BufferConfig()
    source, t = signal_generator(spark, "gen", **WAVE), tee_filter("tee", [buffer, buffer])
    half, plus = map_filter("half", ops.scale(0.5), ops.offset(10)), map_filter("same", ops.identity)
    both = Filter("sum", lambda a, b: [ops.elementwise(a, b, "add")], 2, 1, contract=Contract().require("sample_period_ns", "aligned", ports=[0, 1]))
    p = Pipeline("diamond", [both, plus, half, t, source], [(source, 0, t, 0), (t, 0, half, 0), (t, 1, plus, 0), (half, 0, both, 0), (plus, 0, both, 1)], None, (both, 0))
    assert p.validate().sample_period_ns == WAVE["period_ns"]
    assert [f.name for f in p.order()][0] == "gen"
    got, plain = p.frames()[0].orderBy("t_ns").collect(), source.frames()[0].orderBy("t_ns").collect()
    assert [x.value for x in got] == pytest.approx([1.5 * x.value + 10 for x in plain], abs=1e-4)


def test_pipeline_errors(spark):
    a, b, c = (passthrough_filter(n) for n in "abc")
    with pytest.raises(StreamError, match="cycle"):
        Pipeline("p", [a, b], [(a, 0, b, 0), (b, 0, a, 0)], None, (b, 0)).validate({0: Properties()})
    with pytest.raises(StreamError, match="INVALID_CONFIG"):
        Pipeline("p", [c], [(c, 0, passthrough_filter("x"), 0)], (c, 0), (c, 0))
    with pytest.raises(StreamError, match="NULL_POINTER"):
        Pipeline("p", [], [], None, (c, 0))
    with pytest.raises(StreamError, match="no data source"):
        Pipeline("p", [c], [], None, (c, 0)).validate()
    d, e = map_filter("d"), sample_aligner("e", 1000)
    alone = Pipeline("p", [d, e], [(d, 0, e, 0)], (d, 0), (e, 0))
    alone.declare_external_input(0, d)
    with pytest.raises(StreamError, match=r"\(Connection: d\[0\] -> e\[0\]\)"):
        alone.validate({0: from_buffer(BufferConfig())})  # the period is unknown
    known = from_buffer(BufferConfig()).with_value("sample_period_ns", 1000)
    assert alone.validate({0: known}).sample_period_ns == 1000
    with pytest.raises(StreamError, match="Data type mismatch"):  # external inputs are held against the contract
        alone.validate({0: Properties(data_type=Dtype.I32, min_batch_capacity=1, max_batch_capacity=1)})
    with pytest.raises(StreamError, match="no external input mapping"):
        Pipeline("p", [g := map_filter("g")], [], (g, 0), (g, 0)).validate({0: known})
    h, i = map_filter("h"), map_filter("i")
    with pytest.raises(StreamError, match="'i' input port 0 has no upstream connection"):
        Pipeline("p", [h, i], [], (h, 0), (i, 0)).validate()
    with pytest.raises(StreamError):
        alone.declare_external_input(10, d)


def test_matcher_takes_its_size_from_the_sink(spark):
    source = signal_generator(spark, "gen", kind=Waveform.SINE, frequency_hz=10.0, period_ns=1_000_000, max_samples=600)
    m, sink = batch_matcher("match", 1_000_000), debug_output("out", BufferConfig(batch_expo=8))
    connect(source, 0, m)
    with pytest.raises(StreamError, match="NO_SINK"):
        m.frames()
    connect(m, 0, sink, checked=False)
    assert [x.n for x in sink.frames()[0].collect()] == [256, 256]
    with pytest.raises(StreamError, match="PROPERTY_MISMATCH"):
        connect(passthrough_filter("p"), 0, batch_matcher("q", 5))


def test_twelve_stages_are_one_plan(spark):
    source = signal_generator(spark, "gen", **WAVE)
    last = source
    for i in range(12):
        f = map_filter(f"m{i}", ops.offset(1))
        connect(last, 0, f)
        last = f
    df = last.frames()[0]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg(F.count("*")).first()[0] == 100
    assert last.stats(df).first().samples_processed == 100
