"""Operators against plain versions, goldens and invariants."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from chronoweave import operators as ops
from chronoweave.functions import bits32, c_fixed, ceil_div, float_bits, floor_div, hex32, human_time, narrow, number_text, split_time
from chronoweave.model import PROFILES, BufferConfig, Dtype, ErrorCode, Overflow, StreamError
from chronoweave.operators.batching import RunFold


def frame(spark, rows, value="float"):
    return spark.createDataFrame(rows, f"series_id string, seq long, t_ns long, period_ns long, value {value}")


def ramp(spark, n, period=1000, start=0, series="a"):
    return frame(spark, [(series, i, start + i * period, period, float(i)) for i in range(n)])


def plain_runs(times, capacity, detect=True):
    """The rule restated: grow a list while each time is where the first difference puts it."""
    out, batch = [], []
    for t in times:
        fits = batch and detect and len(batch) < capacity and (len(batch) == 1 or t == batch[0] + len(batch) * (batch[1] - batch[0]))
        if batch and not fits:
            out.append(batch)
            batch = []
        batch.append(t)
    out += [batch] if batch else []
    return [(b[0], len(b), b[1] - b[0] if len(b) > 1 else 0) for b in out]


MS = 1_000_000


@pytest.mark.parametrize(
    ("times", "capacity", "detect", "expected"),
    [
        ([k * MS for k in range(1, 6)], 4, True, [(MS, 4, MS), (5 * MS, 1, 0)]),
        ([1 * MS, 2 * MS, 3 * MS, 8 * MS, 9 * MS], 8, True, [(MS, 3, MS), (8 * MS, 2, MS)]),
        ([MS, 1_500_000, 3 * MS, 3_100_000], 8, False, [(MS, 1, 0), (1_500_000, 1, 0), (3 * MS, 1, 0), (3_100_000, 1, 0)]),
        ([0, 1000, 2001, 3001, 4001], 8, True, [(0, 2, 1000), (2001, 3, 1000)]),
        ([0, 1001, 2003, 3000], 8, True, [(0, 2, 1001), (2003, 2, 997)]),
        ([], 8, True, []),
    ],
)
def test_runs_goldens(times, capacity, detect, expected):
    assert list(ops.runs_of(times, capacity, detect)) == expected == plain_runs(times, capacity, detect)


def test_runs_of_random_times_and_resumed_folds():
    r = random.Random(5)
    for _ in range(300):
        t, times = 0, []
        for _ in range(r.randint(0, 60)):
            t += r.choice([10, 10, 10, 10, 7, 25, -3])
            times.append(t)
        capacity = r.choice([1, 2, 4, 8])
        expected = plain_runs(times, capacity)
        assert list(ops.runs_of(times, capacity)) == expected
        got, state = [], (0, 0, 0)
        for t in times:  # the state alone carries the fold from one piece to the next
            fold = RunFold(capacity, True, state)
            got += [b] if (b := fold.push(t)) else []
            state = fold.state
        got += [b] if (b := RunFold(capacity, True, state).close()) else []
        assert got == expected


def test_regular_batches_keep_all_samples(spark):
    r = random.Random(2)
    rows, expected = [], {}
    for s in "abc":
        t, times = 0, []
        for i in range(200):
            t += r.choice([10, 10, 10, 30])
            times.append(t)
            rows.append((s, i, t, 0, 0.0))
        expected[s] = plain_runs(times, 16)
    r.shuffle(rows)
    got = {}
    for x in ops.regular_batches(frame(spark, rows), 16).orderBy("series_id", "batch_id").collect():
        got.setdefault(x.series_id, []).append((x.t_ns, x.n, x.period_ns))
    assert got == expected


def test_capacity_is_a_power_of_two(spark):
    with pytest.raises(StreamError, match="INVALID_CONFIG"):
        ops.regular_batches(ramp(spark, 1), 12)


def test_map_chain_and_single_projection(spark):
    out = ops.map_samples(ramp(spark, 1280), ops.scale(2), ops.offset(100))
    assert [x.value for x in out.orderBy("seq").collect()] == [2.0 * i + 100 for i in range(1280)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1 and "Exchange" not in plan


def test_map_rounds_each_stage(spark):
    rows = frame(spark, [("a", 0, 0, 0, 0.1)])
    once = ops.map_samples(rows, ops.scale(3), ops.scale(7)).first().value
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    assert once == f32(f32(f32(0.1) * 3) * 7)


def test_failing_map(spark):
    with pytest.raises(Exception, match="map failed"):
        ops.map_samples(ramp(spark, 3), ops.failing()).collect()


@pytest.mark.parametrize("capacity", [64, 256])
def test_reframing_keeps_the_sequence(spark, capacity):
    out = ops.to_batches(ramp(spark, 768), capacity).orderBy("batch_id").collect()
    assert [len(x.data) for x in out] == [capacity] * (768 // capacity)
    assert [v for x in out for v in x.data] == [float(i) for i in range(768)]
    stamps = ops.frame_stamps(ramp(spark, 768), capacity).orderBy("batch_id").collect()
    assert [(x.t_ns, x.period_ns, x.n) for x in stamps] == [(x.t_ns, x.period_ns, x.n) for x in out]


def test_batches_back_to_samples(spark):
    df = ramp(spark, 100, 250, 7)
    back = ops.sample_times(ops.to_batches(df, 16)).orderBy("batch_id", "pos").collect()
    assert [(x.t_ns, x.value) for x in back] == [(7 + 250 * i, float(i)) for i in range(100)]


@pytest.mark.parametrize(("strategy", "phase", "expected"), [
    ("nearest", 0, 0), ("nearest", 249, 0), ("nearest", 250, 0), ("nearest", 500, 1000), ("nearest", 999, 1000),
    ("backward", 999, 0), ("forward", 1, 1000), ("forward", 0, 1000),
])
def test_align_strategies(spark, strategy, phase, expected):
    base = 5000
    out = ops.align(ramp(spark, 10, 1000, base + phase), 1000, strategy).orderBy("seq").collect()
    assert [x.t_ns for x in out] == [base + expected + 1000 * i for i in range(10)]
    assert [x.value for x in out] == [float(i) for i in range(10)]


def test_align_with_period_one_moves_forward(spark):
    assert ops.align(ramp(spark, 1, 1, 5), 1).first().t_ns == 6


def test_align_regular_is_align_without_gaps(spark):
    df = ramp(spark, 50, 1000, 345)
    key = lambda d: [(x.seq, x.t_ns) for x in d.orderBy("seq").collect()]
    assert key(ops.align(df, 1000)) == key(ops.align_regular(df, 1000))


@pytest.mark.parametrize("bad", [None, 0, -5])
def test_period_is_needed(spark, bad):
    with pytest.raises(StreamError, match="INVALID_CONFIG"):
        ops.align(ramp(spark, 1), bad)


def test_align_options_are_checked(spark):
    for settings in ({"strategy": "up"}, {"method": "magic"}, {"boundary": "none"}):
        with pytest.raises(StreamError):
            ops.align(ramp(spark, 1), 10, **settings)


def test_match_64_to_128(spark):
    out = ops.match_frames(ramp(spark, 64 * 10, MS), MS, 128).orderBy("batch_id").collect()
    assert [(x.n, x.t_ns % (128 * MS), len(x.data)) for x in out] == [(128, 0, 128)] * 5
    assert [v for x in out for v in x.data] == [float(i) for i in range(640)]


def test_match_drops_incomplete_frames_and_counts_them(spark):
    df = ramp(spark, 30, 10, 50)  # starts in the middle of a frame of 8
    assert [x.frame for x in ops.match_stamps(df, 10, 8).orderBy("frame").collect()] == [1, 2, 3]
    s = ops.match_stats(df, 10, 8).first()
    assert (s.processed, s.matched, s.skipped) == (30, 24, 6)
    assert ops.match_stamps(df, 10, 8, emit_partial=True).count() == 5


def test_match_frames_never_gathers_more_than_a_frame(spark):
    df = frame(spark, [("a", i, i % 4, 1, float(i)) for i in range(100)] + [("a", 100 + i, 8 + i, 1, float(i)) for i in range(8)])
    assert [(x.batch_id, x.n) for x in ops.match_frames(df, 1, 8).collect()] == [(1, 8)]


def test_phase_error(spark):
    assert ops.check_phase(ramp(spark, 4, 1000, 2000), 1000).count() == 4
    with pytest.raises(Exception, match="PHASE_ERROR"):
        ops.check_phase(ramp(spark, 4, MS, 12_345_000), MS).collect()


def test_overflow_policies(spark):
    batches = ops.frame_stamps(ramp(spark, 32), 4)  # 8 batches for 7 slots
    held = lambda p: sorted(x.batch_id for x in ops.overflow(batches, BufferConfig(batch_expo=2, ring_expo=3, overflow=p)).collect())
    assert held(Overflow.BLOCK) == list(range(8))
    assert held(Overflow.DROP_HEAD) == list(range(7))
    assert held(Overflow.DROP_TAIL) == list(range(1, 8))
    s = ops.drop_stats(batches, BufferConfig(batch_expo=2, ring_expo=3, overflow=Overflow.DROP_TAIL)).first()
    assert (s.batches, s.dropped, s.drop_rate) == (8, 1, 12.5)


@pytest.mark.parametrize("name", PROFILES)
def test_samples_survive_every_buffer_profile(spark, name):
    config = PROFILES[name]
    out = ops.to_batches(ops.passthrough(ramp(spark, 500)), config.capacity)
    assert out.selectExpr("sum(n) n").first().n == 500
    assert config.slots == 2**config.ring_expo - 1


def test_buffer_limits():
    for settings in ({"ring_expo": 31}, {"batch_expo": 21}, {"dtype": Dtype.NDEF}):
        with pytest.raises(StreamError):
            BufferConfig(**settings)


def test_tee_checks(spark):
    df = ramp(spark, 4)
    for n in (1, 11):
        with pytest.raises(StreamError):
            ops.tee(df, n)
    with pytest.raises(StreamError, match="TYPE_MISMATCH"):
        ops.tee(df, 2, BufferConfig(), [BufferConfig(), BufferConfig(Dtype.I32)])
    with pytest.raises(StreamError, match="CAPACITY_MISMATCH"):
        ops.tee(df, 2, BufferConfig(), [BufferConfig(), BufferConfig(batch_expo=3)])
    assert {x.branch: x.written for x in ops.write_counts(ops.tee(df, 3)).collect()} == {0: 4, 1: 4, 2: 4}


def test_passthrough_capacities(spark):
    with pytest.raises(StreamError, match="CAPACITY_MISMATCH"):
        ops.passthrough(ramp(spark, 1), 64, 128)


def test_routing_keeps_every_batch_once(spark):
    batches = ops.frame_stamps(ramp(spark, 64), 4)
    for parts in (ops.round_robin(batches, 3), ops.load_balance(batches, 3)):
        assert sorted(x.batch_id for p in parts for x in p.collect()) == list(range(16))


def test_previous_across_segments(spark):
    df = frame(spark, [(s, i, i * 10, 0, float(i)) for s in "ab" for i in range(25)])
    out = ops.with_previous(df, {"was": "value"}, segment_rows=4).orderBy("series_id", "seq").collect()
    assert [x.was for x in out] == [None, *map(float, range(24))] * 2


def test_seq_across_segments(spark):
    rows = [("a", t, e) for e, t in enumerate([50, 10, 10, 30, 99])] + [("b", 7, 9)]
    df = spark.createDataFrame(rows, "series_id string, t_ns long, event_id long")
    out = ops.with_seq(df, [F.col("event_id")], segment_ns=20).orderBy("series_id", "seq").collect()
    assert [(x.series_id, x.seq, x.event_id) for x in out] == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 0), ("a", 4, 4), ("b", 0, 9)]


def test_statistics(spark):
    df = frame(spark, [("a", i, i * MS + (5 * MS if i > 6 else 0), MS, float(i if i != 4 else 40)) for i in range(10)])
    assert ops.sequence_errors(df).first()[1:] == (1, 4)
    assert ops.timing_gaps(df, MS).first()[1:] == (1, 6 * MS)
    assert ops.latency(df).first()[2:] == (MS, 6 * MS)
    assert ops.counters(df, 4).first()[1:] == (3, 10)
    wave = frame(spark, [("a", i, 0, 0, float(v)) for i, v in enumerate([1, -1, -1, 0, 2, -3])])
    assert ops.zero_crossings(wave, 1000).first().crossings == 3


def test_moving_average_across_segments(spark):
    out = ops.moving_average(ramp(spark, 40), 4, segment_rows=3).orderBy("seq").collect()
    for i, x in enumerate(out):
        part = range(max(0, i - 3), i + 1)
        assert x.average == pytest.approx(sum(part) / len(part))


def test_low_pass(spark):
    df = frame(spark, [(s, i, i, 0, float((i * 7) % 5)) for s in "ab" for i in range(50)])
    y, expected = None, []
    for i in range(50):
        x = float((i * 7) % 5)
        y = x if y is None else y + 0.5 * (x - y)
        expected.append(y)
    out = ops.low_pass(df, 0.5).orderBy("series_id", "seq").collect()
    assert [x.value for x in out] == pytest.approx(expected * 2, rel=1e-6)
    assert ops.remove_dc(df, 0.5).where("seq = 0").first().value == 0.0


def test_regularize_and_fill(spark):
    df = frame(spark, [("a", 0, 5, 0, 0.0), ("a", 1, 25, 0, 2.0), ("a", 2, 40, 0, 5.0)])
    hold = ops.regularize(df, 10).orderBy("t_ns").collect()
    assert [(x.t_ns, x.value) for x in hold] == [(10, 0.0), (20, 0.0), (30, 2.0), (40, 5.0)]
    line = ops.regularize(df, 10, "linear").orderBy("t_ns").collect()
    assert [(x.t_ns, round(x.value, 4)) for x in line] == [(10, 0.5), (20, 1.5), (30, 3.0), (40, 5.0)]
    grid = frame(spark, [("a", 0, 0, 0, 1.0), ("a", 1, 10, 0, 2.0), ("a", 2, 40, 0, 3.0)])
    assert [(x.t_ns, x.value, x.filled) for x in ops.fill_gaps(grid, 10).orderBy("t_ns").collect()] == [
        (0, 1.0, False), (10, 2.0, False), (20, 2.0, True), (30, 2.0, True), (40, 3.0, False),
    ]


def test_sample_and_hold_across_segments(spark):
    left = frame(spark, [("l", i, i * 10, 0, float(i)) for i in range(12)])
    right = frame(spark, [("r", 0, 25, 0, 1.0), ("r", 1, 26, 0, 2.0), ("r", 2, 90, 0, 3.0)])
    out = ops.sample_and_hold(left, right, segment_ns=20).orderBy("t_ns").collect()
    assert [x.held for x in out] == [None] * 3 + [2.0] * 6 + [3.0] * 3


def test_channels(spark):
    wide = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, None)], "t_ns long, x double, y double")
    back = ops.combine_channels(ops.split_channels(wide, ["x", "y"]), ["x", "y"]).orderBy("t_ns").collect()
    assert [tuple(r) for r in back] == [(1, 2.0, 3.0), (2, 4.0, None)]


def test_formats(spark):
    values = [0.125, 0.375, 1.005, -2.5, 1234567.0, 0.0, -0.0, 1e-9, float("nan"), float("inf"), 2.675]
    out = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [x[0] for x in out.select(c_fixed(F.col("v"), 2)).collect()] == ["%.2f" % v for v in values]
    floats = spark.createDataFrame([(0.1,), (-1.5,), (0.0,), (3e38,)], "v float")
    raw = [struct.unpack("I", struct.pack("f", v))[0] for v in (0.1, -1.5, 0.0, 3e38)]
    got = floats.select(hex32(float_bits("v")), bits32(float_bits("v"))).collect()
    assert [tuple(x) for x in got] == [(f"0x{b:08X}", f"0b{b:032b}") for b in raw]
    whole = spark.createDataFrame([(-1,), (7,)], "v int")
    assert [x[0] for x in whole.select(number_text(F.col("v"), Dtype.I32, "hex")).collect()] == ["0xFFFFFFFF", "0x00000007"]
    assert floats.select(number_text(F.col("v"), Dtype.FLOAT, "scientific")).first()[0] == "%e" % struct.unpack("f", struct.pack("f", 0.1))[0]


def test_times_and_narrowing(spark):
    t = spark.createDataFrame([(0,), (999,), (5_000,), (7_003_000,), (12_345_678_901,), (-1,)], "t long")
    assert [x[0] for x in t.select(human_time(F.col("t"))).collect()][:5] == ["---", "999ns", "5μs", "7.003ms", "12.345s"]
    parts = t.select(split_time(F.col("t"))["sec"], split_time(F.col("t"))["nsec"]).collect()
    assert tuple(parts[4]) == (12, 345_678_901) and tuple(parts[5]) == (-1, 999_999_999)
    n = spark.createDataFrame([(1.9,), (-1.9,), (3e9,), (5e9,)], "v double")
    assert [x[0] for x in n.select(narrow(F.col("v"), Dtype.I32)).collect()] == [1, -1, None, None]
    assert [x[0] for x in n.select(narrow(F.col("v"), Dtype.U32)).collect()] == [1, None, 3_000_000_000, None]


def test_error_codes():
    assert ErrorCode.OK.value == 0 and ErrorCode.COMPLETE.value == 1 and len(ErrorCode) == 49
    assert StreamError("PHASE_ERROR", "x").code is ErrorCode.PHASE_ERROR


def test_whole_division_beyond_doubles(spark):
    big = 1_700_000_000_000_000_000
    values = [(big * 5 + d,) for d in (-1, 0, 1)] + [(-1,), (-5,), (-6,), (0,), (4,), (5,)]
    got = spark.createDataFrame(values, "x long").select("x", floor_div(F.col("x"), 5), ceil_div(F.col("x"), 5)).collect()
    assert [tuple(r) for r in got] == [(x, x // 5, -(-x // 5)) for (x,) in values]
    frames = ops.match_stamps(frame(spark, [("a", 0, 480 * 10**9 * 3_600_000 - 1, 1, 0.0)]), 60 * 10**9, 8, emit_partial=True)
    assert frames.first().frame == 3_599_999


def test_spectrum(spark):
    import numpy as np

    x = np.sin(2 * np.pi * 4 * np.arange(64) / 64) + 0.1 * np.cos(2 * np.pi * 9 * np.arange(64) / 64) + 3
    df = frame(spark, [("a", i, i * MS, MS, float(v)) for i, v in enumerate(x)])
    got = ops.power_spectrum(ops.to_batches(df, 64))
    power = {r.bin: r.power for r in got.collect()}
    assert power[0] == pytest.approx(9, abs=1e-5) and power[4] == pytest.approx(0.5, abs=1e-5) and power[9] == pytest.approx(0.005, abs=1e-5)
    assert sum(power.values()) == pytest.approx(float((x**2).mean()), abs=1e-4)
    best = ops.signal_to_noise(got).first()
    assert best.frequency_hz == pytest.approx(62.5) and best.snr_db == pytest.approx(20, abs=0.01)


def test_auto_scale(spark):
    out = ops.auto_scale(frame(spark, [("a", i, i, 0, float(v)) for i, v in enumerate([2, 4, 6])] + [("b", 0, 0, 0, 9.0)]))
    assert [x.value for x in out.orderBy("series_id", "seq").collect()] == [-1.0, 0.0, 1.0, 0.0]
