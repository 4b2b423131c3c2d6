"""One query for each operator on the test tables, and the same rows as DuckDB SQL.

Series are the users of ``events`` with values as floats, numbered by time and event_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .functions import c_fixed, file_name, float_bits, floor_div, hex32, human_time, narrow, number_text, period_to_rate, split_time
from .model import BufferConfig, Dtype, Overflow
from .sinks import csv_frame, csv_lines, debug_lines, size_limited
from .sources import Pattern, Waveform, discover_header, event_samples, function_samples, parse_lines, pattern_samples, signal_samples, variable_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Grid of the frames, and samples of a frame.
MINUTE, FRAME, HOUR = 60_000_000_000, 8, 3_600_000_000_000
TURN = repr(2 * math.pi)

#: The event samples in SQL; every oracle on events starts with it.
SAMPLES = """WITH samples AS (
    SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
        epoch_us(ts) * 1000 AS t_ns, CAST(value AS FLOAT) AS value, event_id FROM events
)"""


def query(oracle: str | None = None, samples: bool = True) -> Callable[[Query], Query]:
    """Registers a query; ``samples`` puts the event samples before its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"{SAMPLES} {oracle}" if samples and not oracle.lstrip().startswith(",") else f"{SAMPLES}{oracle}" if samples else oracle
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(read(spark, sf_dir, "events"))


# Flagship: samples, map, align, match ---------------------------------------------------------------------------------


@query(f""", mapped AS (SELECT series_id, seq, t_ns, CAST(CAST(value AS DOUBLE) * 2.5 AS FLOAT) AS value FROM samples),
    based AS (SELECT *, first_value(t_ns) OVER (PARTITION BY series_id ORDER BY seq) AS t0 FROM mapped),
    aligned AS (SELECT series_id, seq, value, (CASE WHEN t0 % {MINUTE} < {MINUTE // 2} THEN t0 - t0 % {MINUTE} ELSE t0 + {MINUTE} - t0 % {MINUTE} END)
        + seq * {MINUTE} AS t_ns FROM based)
    SELECT series_id, t_ns // {MINUTE * FRAME} AS frame, t_ns // {MINUTE * FRAME} * {MINUTE * FRAME} AS t_ns, CAST(count(*) AS INT) AS n,
        arg_min(value, seq) AS first_value, arg_max(value, seq) AS last_value FROM aligned GROUP BY 1, 2, 3 HAVING count(*) = {FRAME}""")
def align_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = ops.map_samples(samples(spark, sf_dir), ops.scale(2.5))
    return ops.match_stamps(ops.align(mapped, MINUTE), MINUTE, FRAME)


# Maps -------------------------------------------------------------------------------------------------------------------


def _mapped(name: str, sql: str, *functions) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.map_samples(samples(spark, sf_dir), *functions).select("series_id", "seq", "t_ns", "value")

    run.__name__ = name
    query(f"SELECT series_id, seq, t_ns, {sql} AS value FROM samples")(run)


_mapped("map_identity", "value", ops.identity)
_mapped("map_scale", "CAST(CAST(value AS DOUBLE) * 2 AS FLOAT)", ops.scale(2))
_mapped("map_offset", "CAST(CAST(value AS DOUBLE) + 10 AS FLOAT)", ops.offset(10))
_mapped("map_chain", "CAST(CAST(CAST(CAST(value AS DOUBLE) * 2 AS FLOAT) AS DOUBLE) + 100 AS FLOAT)", ops.scale(2), ops.offset(100))


@query("SELECT series_id, seq, t_ns, CAST(value * 3 AS FLOAT) AS value FROM samples")
def map_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An opaque function of blocks, through Arrow."""
    return ops.map_blocks(samples(spark, sf_dir), lambda x: x * 3).select("series_id", "seq", "t_ns", "value")


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) * 2 AS FLOAT) AS DOUBLE) + 100 AS value FROM lineitem", samples=False)
def map_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map chain on the largest table: one projection over a scan of three columns."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("float").alias("value"))
    return ops.map_samples(rows, ops.scale(2), ops.offset(100)).withColumn("value", F.col("value").cast("double"))


@query("SELECT series_id, seq, t_ns, value FROM samples")
def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.passthrough(samples(spark, sf_dir), 64, 64).select("series_id", "seq", "t_ns", "value")


@query("""SELECT series_id, seq, CAST(trunc(CAST(value AS DOUBLE)) AS INT) AS i32,
    CASE WHEN trunc(CAST(value AS DOUBLE)) >= 0 THEN CAST(trunc(CAST(value AS DOUBLE)) AS BIGINT) END AS u32 FROM samples""")
def cast_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = samples(spark, sf_dir)
    return out.select("series_id", "seq", narrow(F.col("value"), Dtype.I32).alias("i32"), narrow(F.col("value"), Dtype.U32).alias("u32"))


_STATE = """WITH RECURSIVE samples AS MATERIALIZED (
        SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
            CAST(CAST(value AS FLOAT) AS DOUBLE) AS x FROM events
    ), fold AS (
        SELECT series_id, seq, x, x AS y FROM samples WHERE seq = 0
        UNION ALL
        SELECT s.series_id, s.seq, s.x, f.y + 0.25::DOUBLE * (s.x - f.y) FROM fold f JOIN samples s ON s.series_id = f.series_id AND s.seq = f.seq + 1
    )
    SELECT series_id, seq, CAST({value} AS FLOAT) AS value FROM fold"""


@query(_STATE.format(value="x - y"), samples=False)
def remove_dc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.remove_dc(samples(spark, sf_dir), 0.25).select("series_id", "seq", "value")


@query(_STATE.format(value="y"), samples=False)
def low_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.low_pass(samples(spark, sf_dir), 0.25).select("series_id", "seq", "value")


# Batches ----------------------------------------------------------------------------------------------------------------


@query("""SELECT series_id, seq // 64 AS batch_id, arg_min(t_ns, seq) AS t_ns, CAST(0 AS BIGINT) AS period_ns, CAST(count(*) AS INT) AS n
    FROM samples GROUP BY series_id, seq // 64""")
def map_reframe_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.frame_stamps(samples(spark, sf_dir), 64)


@query("""SELECT series_id, seq // 16 AS batch_id, min(t_ns) AS t_ns, CAST(count(*) AS INT) AS n,
    arg_min(value, seq) AS first_value, arg_max(value, seq) AS last_value FROM samples GROUP BY series_id, seq // 16""")
def batch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.to_batches(samples(spark, sf_dir), 16)
    return out.select("series_id", "batch_id", "t_ns", "n", F.element_at("data", 1).alias("first_value"), F.element_at("data", -1).alias("last_value"))


@query("""SELECT CAST(label AS VARCHAR) AS series_id, vec_id AS batch_id, CAST(pos - 1 AS INT) AS pos, 1000000 * vec_id * 64 + (pos - 1) * 1000000 AS t_ns, embedding[pos] AS value
    FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)""", samples=False)
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches to samples: sample i is at t_ns + i * period_ns."""
    rows = read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("series_id"), F.col("vec_id").alias("batch_id"), (F.col("vec_id") * 64_000_000).alias("t_ns"),
        F.lit(1_000_000).cast("long").alias("period_ns"), F.col("embedding").alias("data"),
    )
    return ops.sample_times(rows).select("series_id", "batch_id", "pos", "t_ns", "value")


_FOLD = """WITH RECURSIVE samples AS (
        SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
            epoch_us(ts) * 1000 // {grid} * {grid} AS t_ns FROM events
    ), fold AS (
        SELECT series_id, seq, t_ns AS t0, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS delta, CAST(0 AS BIGINT) AS batch_id FROM samples WHERE seq = 0
        UNION ALL
        SELECT s.series_id, s.seq,
            CASE WHEN {close} THEN s.t_ns ELSE f.t0 END, CASE WHEN {close} THEN 1 ELSE f.n + 1 END,
            CASE WHEN {close} THEN 0 WHEN f.n = 1 THEN s.t_ns - f.t0 ELSE f.delta END, CASE WHEN {close} THEN f.batch_id + 1 ELSE f.batch_id END
        FROM fold f JOIN samples s ON s.series_id = f.series_id AND s.seq = f.seq + 1
    )
    SELECT series_id, batch_id, arg_max(t0, seq) AS t_ns, CASE WHEN max(n) > 1 THEN arg_max(delta, seq) ELSE 0 END AS period_ns, CAST(max(n) AS INT) AS n
    FROM fold GROUP BY series_id, batch_id"""


@query(_FOLD.format(grid=HOUR * 24, close="(f.n >= 8 OR (f.n > 1 AND s.t_ns <> f.t0 + f.n * f.delta))"), samples=False)
def regular_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of constant period; times are cut to days so that there are some."""
    days = samples(spark, sf_dir).withColumn("t_ns", floor_div(F.col("t_ns"), HOUR * 24) * (HOUR * 24))
    return ops.regular_batches(days, 8)


@query("SELECT series_id, seq AS batch_id, t_ns, CAST(0 AS BIGINT) AS period_ns, CAST(1 AS INT) AS n FROM samples")
def irregular_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.regular_batches(samples(spark, sf_dir), 64, detect=False)


# Aligner and matcher ----------------------------------------------------------------------------------------------------


def _aligned(name: str, strategy: str, base: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.align(samples(spark, sf_dir), MINUTE, strategy).select("series_id", "seq", "t_ns", "value")

    run.__name__ = name
    query(f""", based AS (SELECT *, first_value(t_ns) OVER (PARTITION BY series_id ORDER BY seq) AS t0 FROM samples)
        SELECT series_id, seq, {base} + seq * {MINUTE} AS t_ns, value FROM based""")(run)


_BACK, _ON = f"t0 - t0 % {MINUTE}", f"t0 + {MINUTE} - t0 % {MINUTE}"
_aligned("align_nearest", "nearest", f"(CASE WHEN t0 % {MINUTE} < {MINUTE // 2} THEN {_BACK} ELSE {_ON} END)")
_aligned("align_backward", "backward", f"({_BACK})")
_aligned("align_forward", "forward", f"({_ON})")


@query(f""", based AS (SELECT *, first_value(t_ns) OVER (PARTITION BY series_id ORDER BY seq) AS t0 FROM samples)
    SELECT series_id, seq, t_ns - t0 % {MINUTE} AS t_ns FROM based""")
def align_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.align_regular(samples(spark, sf_dir), MINUTE, "backward").select("series_id", "seq", "t_ns")


@query(f"SELECT series_id, count(*) AS samples, arg_min(t_ns, seq) % {MINUTE} AS max_phase_ns FROM samples GROUP BY series_id")
def align_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.align_stats(samples(spark, sf_dir), MINUTE)


_GRID = f""", grid AS (SELECT series_id, seq, t_ns // {HOUR} * {HOUR} AS t_ns, value FROM samples)"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("t_ns", floor_div(F.col("t_ns"), HOUR) * HOUR)


@query(_GRID + f""" SELECT series_id, t_ns // {HOUR * 24} AS frame, t_ns // {HOUR * 24} * {HOUR * 24} AS t_ns, CAST(count(*) AS INT) AS n,
    arg_min(value, seq) AS first_value, arg_max(value, seq) AS last_value FROM grid GROUP BY 1, 2, 3 HAVING count(*) = 3""")
def batch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a day that have exactly three samples (a frame's size is its period here, so counts vary)."""
    out = ops.match_stamps(_hours(spark, sf_dir), HOUR, 24, emit_partial=True)
    return out.where("n = 3")


@query(f""", based AS (SELECT *, first_value(t_ns) OVER (PARTITION BY series_id ORDER BY seq) AS t0 FROM samples),
    aligned AS (SELECT series_id, seq, value, t0 - t0 % {MINUTE} + seq * {MINUTE} AS t_ns FROM based)
    SELECT series_id, t_ns // {MINUTE * 16} AS batch_id, t_ns // {MINUTE * 16} * {MINUTE * 16} AS t_ns, CAST({MINUTE} AS BIGINT) AS period_ns, CAST(16 AS INT) AS n,
        arg_min(value, seq) AS first_value, arg_max(value, seq) AS last_value FROM aligned GROUP BY 1, 2, 3 HAVING count(*) = 16""")
def match_frames_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher with its data."""
    out = ops.match_frames(ops.align(samples(spark, sf_dir), MINUTE, "backward"), MINUTE, 16)
    ends = [F.element_at("data", 1).alias("first_value"), F.element_at("data", -1).alias("last_value")]
    return out.select("series_id", "batch_id", "t_ns", "period_ns", "n", *ends)


@query(f""", based AS (SELECT *, first_value(t_ns) OVER (PARTITION BY series_id ORDER BY seq) AS t0 FROM samples),
    aligned AS (SELECT series_id, t0 - t0 % {MINUTE} + seq * {MINUTE} AS t_ns FROM based),
    frames AS (SELECT series_id, t_ns // {MINUTE * FRAME} AS frame, count(*) AS n FROM aligned GROUP BY 1, 2)
    SELECT series_id, CAST(sum(n) AS BIGINT) AS processed, CAST(sum(CASE WHEN n = {FRAME} THEN n ELSE 0 END) AS BIGINT) AS matched,
        CAST(sum(CASE WHEN n = {FRAME} THEN 0 ELSE n END) AS BIGINT) AS skipped FROM frames GROUP BY series_id""")
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.match_stats(ops.align(samples(spark, sf_dir), MINUTE, "backward"), MINUTE, FRAME)


# Sources ----------------------------------------------------------------------------------------------------------------


def _wave(name: str, kind: Waveform, sql: str, phase: float = -1.3) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = signal_samples(spark, kind, 1000.0, 20833, 4800, amplitude=2.0, phase=phase, offset=0.5)
        return out.select("seq", "t_ns", "value")

    run.__name__ = name
    angle = f"(CAST(i * 20833 AS DOUBLE) * {2 * math.pi * 1000.0 * 1e-9!r} + {phase!r})"
    part = f"(CASE WHEN {angle} % {TURN} < 0 THEN {angle} % {TURN} + {TURN} ELSE {angle} % {TURN} END)"
    wave = sql.format(angle=angle, part=part, pi=repr(math.pi), turn=TURN)
    query(f"SELECT i AS seq, i * 20833 AS t_ns, CAST(2.0::DOUBLE * ({wave}) + 0.5::DOUBLE AS FLOAT) AS value FROM range(4800) r(i)", samples=False)(run)


_wave("gen_sine", Waveform.SINE, "sin({angle})")
_wave("gen_square", Waveform.SQUARE, "CASE WHEN sin({angle}) >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END")
_wave("gen_sawtooth", Waveform.SAWTOOTH, "{part} * 2.0::DOUBLE / {turn} - 1.0::DOUBLE")
_wave("gen_triangle", Waveform.TRIANGLE, "CASE WHEN {part} < {pi} THEN {part} * 2.0::DOUBLE / {pi} - 1.0::DOUBLE ELSE 3.0::DOUBLE - {part} * 2.0::DOUBLE / {pi} END")


@query("SELECT CAST(100 AS BIGINT) AS n, CAST(990000000 AS BIGINT) AS last_ns", samples=False)
def gen_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal_samples(spark, Waveform.SINE, 10.0, 10_000_000, 100)
    return out.agg(F.count("*").alias("n"), F.max("t_ns").alias("last_ns"))


@query("SELECT i AS seq, CAST(floor(i * 1000000000 / 48000) AS BIGINT) AS t_ns, CAST(i * i AS FLOAT) AS value FROM range(1000) r(i)", samples=False)
def gen_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_samples(spark, lambda i: i * i, 1000, 48_000).select("seq", "t_ns", "value")


@query("""SELECT 'sequential' AS pattern, i AS seq, CAST(i + 5 AS FLOAT) AS value FROM range(500) r(i)
    UNION ALL SELECT 'constant', i, CAST(42 AS FLOAT) FROM range(500) r(i) UNION ALL SELECT 'sine', i, CAST(sin(CAST(i AS DOUBLE) * 0.1::DOUBLE) AS FLOAT) FROM range(500) r(i)""", samples=False)
def gen_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = [(Pattern.SEQUENTIAL, {"start": 5}), (Pattern.CONSTANT, {"constant": 42}), (Pattern.SINE, {})]
    frames = [pattern_samples(spark, p, 500, 1000, **s).select(F.lit(p.value).alias("pattern"), "seq", "value") for p, s in some]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("""WITH s AS (SELECT i, i % 114 AS r FROM range(1000) r(i))
    SELECT i AS seq, i // 114 * 4 + CASE WHEN r < 64 THEN 0 WHEN r < 96 THEN 1 WHEN r < 97 THEN 2 ELSE 3 END AS batch_id,
        CAST(r - CASE WHEN r < 64 THEN 0 WHEN r < 96 THEN 64 WHEN r < 97 THEN 96 ELSE 97 END AS INT) AS pos FROM s""", samples=False)
def gen_variable_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variable_batches(spark, 1000, [64, 32, 1, 17], 1000).select("seq", "batch_id", "pos")


@query("""SELECT event_id, epoch_us(ts) * 1000 AS t_ns, CAST(value AS FLOAT) AS value FROM events WHERE event_id % 7 <> 3""", samples=False)
def skip_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text made of events, with a bad cell in every seventh line: the source drops these rows."""
    e = read(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    cell = F.when(F.col("event_id") % 7 == 3, "x1").otherwise(F.col("value").cast("string"))
    lines = e.select(F.concat_ws(",", t, F.col("event_id").cast("string"), cell).alias("value"))
    out = parse_lines(lines, ["ts_ns", "event_id", "reading"], "ts_ns", ["event_id", "reading"], skip_invalid=True)
    return out.select(F.col("cw_values")[0].cast("long").alias("event_id"), "t_ns", F.col("cw_values")[1].alias("value"))


@query("SELECT event_id, CAST(value AS FLOAT) AS value FROM events", samples=False)
def merged_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent delimiters count as one, so a cell after two of them moves left."""
    e = read(spark, sf_dir, "events")
    lines = e.select(F.concat(F.lit("0;;"), F.col("event_id").cast("string"), F.lit(";;;"), F.col("value").cast("string")).alias("value"))
    out = parse_lines(lines, ["ts", "event_id", "reading"], "ts", ["event_id", "reading"], delimiter=";")
    return out.select(F.col("cw_values")[0].cast("long").alias("event_id"), F.col("cw_values")[1].alias("value"))


@query("SELECT * FROM (VALUES ('time_ms', 'temperature_c'), ('time_ms', 'humidity_pct'), ('time_ms', 'pressure_hpa')) v(ts_column, data_column)", samples=False)
def header_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, others = discover_header(["time_ms", "temperature_c", "humidity_pct", "pressure_hpa"])
    return spark.createDataFrame([(ts, c) for c in others], "ts_column string, data_column string")


# Sinks ------------------------------------------------------------------------------------------------------------------


@query("SELECT series_id, seq, CAST(t_ns AS VARCHAR) || ',' || format('{:.3f}', CAST(value AS DOUBLE)) AS line FROM samples")
def csv_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_lines(samples(spark, sf_dir), precision=3)


@query(""", lines AS (SELECT series_id, seq, CAST(t_ns AS VARCHAR) || ',' || format('{:.3f}', CAST(value AS DOUBLE)) AS line FROM samples),
    sums AS (SELECT *, 19 + sum(strlen(line) + 1) OVER (PARTITION BY series_id ORDER BY seq) AS end_bytes FROM lines)
    SELECT series_id, seq, line, CAST(end_bytes AS BIGINT) AS end_bytes FROM sums WHERE end_bytes - strlen(line) - 1 < 1000""")
def csv_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_limited(csv_lines(samples(spark, sf_dir), precision=3), 1000, header="timestamp_ns,value")


@query("""WITH wide AS (SELECT epoch_us(ts) * 1000 AS t_ns, max(CASE WHEN event_type = 'click' THEN CAST(value AS FLOAT) END) AS a,
        max(CASE WHEN event_type = 'view' THEN CAST(value AS FLOAT) END) AS b FROM events GROUP BY 1)
    SELECT t_ns, CAST(t_ns AS VARCHAR) || ',' || coalesce(format('{:.6f}', CAST(a AS DOUBLE)), '') || ',' || coalesce(format('{:.6f}', CAST(b AS DOUBLE)), '') AS line FROM wide""", samples=False)
def csv_multi_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_frame(event_samples(read(spark, sf_dir, "events"), "event_type"), ["click", "view"])


@query(""", batches AS (SELECT series_id, seq // 16 AS batch_id, arg_min(t_ns, seq) AS t_ns, count(*) AS n FROM samples GROUP BY 1, 2)
    SELECT series_id, batch_id, CAST(-1 AS INT) AS line_no, '# [Batch t=' || t_ns || 'ns, period=0ns, samples=' || n || ', type=FLOAT]' AS line FROM batches
    UNION ALL SELECT series_id, seq // 16, CAST(seq % 16 AS INT), '#   [' || seq % 16 || '] ' || format('{:.6f}', CAST(value AS DOUBLE)) FROM samples WHERE seq % 16 < 10
    UNION ALL SELECT series_id, batch_id, CAST(10 AS INT), '#   ... (' || (n - 10) || ' more samples)' FROM batches WHERE n > 10
    UNION ALL SELECT series_id, max(batch_id) + 1, CAST(0 AS INT), '# [Stream completed]' FROM batches GROUP BY series_id""")
def debug_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debug_lines(ops.to_batches(samples(spark, sf_dir), 16), prefix="# ", completed=True)


@query("""SELECT event_id, '0x' || lpad(printf('%X', user_id), 8, '0') AS hex, '0b' || lpad(bin(user_id), 32, '0') AS bits FROM events""", samples=False)
def integer_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", number_text(F.col("user_id"), Dtype.U32, "hex").alias("hex"), number_text(F.col("user_id"), Dtype.U32, "binary").alias("bits"))


@query(""", parts AS (
        SELECT series_id, seq, abs(CAST(value AS DOUBLE)) AS x, signbit(value) AS negative, CAST(floor(log2(abs(CAST(value AS DOUBLE)))) AS BIGINT) AS guess
        FROM samples WHERE value <> 0
    ), placed AS (
        SELECT *, CASE WHEN x >= pow(2::DOUBLE, guess + 1) THEN guess + 1 WHEN x < pow(2::DOUBLE, guess) THEN guess - 1 ELSE guess END AS e FROM parts
    ), bits AS (
        SELECT series_id, seq, CASE WHEN negative THEN 2147483648 ELSE 0 END + (e + 127) * 8388608 + CAST((x / pow(2::DOUBLE, e) - 1) * 8388608 AS BIGINT) AS b FROM placed
        UNION ALL SELECT series_id, seq, CASE WHEN signbit(value) THEN 2147483648 ELSE 0 END FROM samples WHERE value = 0
    )
    SELECT series_id, seq, '0x' || lpad(printf('%X', b), 8, '0') AS hex FROM bits""")
def float_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("series_id", "seq", hex32(float_bits("value")).alias("hex"))


# Routing and policies ---------------------------------------------------------------------------------------------------


@query("""SELECT CAST(0 AS INT) AS branch, series_id, seq, CAST(CAST(CAST(CAST(value AS DOUBLE) / 2 AS FLOAT) AS DOUBLE) + 10 AS FLOAT) AS value FROM samples
    UNION ALL SELECT CAST(1 AS INT), series_id, seq, CAST(CAST(value AS DOUBLE) + 5 AS FLOAT) FROM samples""")
def tee_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ops.tee(samples(spark, sf_dir), 2)
    return ops.tee_union([ops.map_samples(a, ops.scale(0.5), ops.offset(10)), ops.map_samples(b, ops.offset(5))]).select("branch", "series_id", "seq", "value")


@query("SELECT CAST(b AS INT) AS branch, count(*) AS written FROM samples, range(3) r(b) GROUP BY 1")
def tee_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.write_counts(ops.tee(samples(spark, sf_dir), 3))


_BATCHES = ", batches AS (SELECT series_id, seq // 4 AS batch_id, count(*) AS n FROM samples GROUP BY 1, 2)"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.frame_stamps(samples(spark, sf_dir), 4)


@query(_BATCHES + " SELECT CAST(batch_id % 3 AS INT) AS branch, series_id, batch_id FROM batches")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tee_union(ops.round_robin(_batches(spark, sf_dir), 3)).select("branch", "series_id", "batch_id")


@query("SELECT CAST(0 AS INT) AS branch, series_id, seq FROM samples WHERE value >= 50 UNION ALL SELECT CAST(1 AS INT), series_id, seq FROM samples WHERE value < 50")
def conditional_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low = ops.route(samples(spark, sf_dir), lambda d: d["value"] >= 50, lambda d: d["value"] < 50)
    return ops.tee_union([high, low]).select("branch", "series_id", "seq")


@query(_BATCHES + " SELECT count(*) AS batches FROM batches")
def load_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tee_union(ops.load_balance(_batches(spark, sf_dir), 4)).agg(F.count("*").alias("batches"))


def _policy(name: str, policy: Overflow, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.overflow(_batches(spark, sf_dir), BufferConfig(batch_expo=2, ring_expo=3, overflow=policy)).select("series_id", "batch_id")

    run.__name__ = name
    query(_BATCHES + f", ends AS (SELECT *, max(batch_id) OVER (PARTITION BY series_id) AS last FROM batches) SELECT series_id, batch_id FROM ends WHERE {sql}")(run)


_policy("block", Overflow.BLOCK, "true")
_policy("drop_head", Overflow.DROP_HEAD, "batch_id < 7")
_policy("drop_tail", Overflow.DROP_TAIL, "batch_id > last - 7")


@query(_BATCHES + """ SELECT series_id, count(*) AS batches, CAST(greatest(count(*) - 7, 0) AS BIGINT) AS dropped,
    100.0::DOUBLE * greatest(count(*) - 7, 0) / count(*) AS drop_rate FROM batches GROUP BY series_id""")
def drop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drop_stats(_batches(spark, sf_dir), BufferConfig(batch_expo=2, ring_expo=3, overflow=Overflow.DROP_TAIL))


@query("SELECT series_id, seq, value FROM samples WHERE seq < 10")
def limit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.limit_samples(samples(spark, sf_dir), 10).select("series_id", "seq", "value")


@query("""SELECT series_id, b AS batch_id, seq - b * 6 AS pos, value FROM samples, LATERAL (SELECT unnest(range(
    CASE WHEN seq < 8 THEN 0 ELSE (seq - 8) // 6 + 1 END, seq // 6 + 1)) AS b)""")
def overlap_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.overlap_batches(samples(spark, sf_dir), 8, 2).select("series_id", "batch_id", "pos", "value")


# Statistics -------------------------------------------------------------------------------------------------------------


@query("SELECT series_id, CAST(max(seq) // 64 + 1 AS BIGINT) AS n_batches, count(*) AS samples_processed FROM samples GROUP BY series_id")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counters(samples(spark, sf_dir), 64)


@query("SELECT series_id, round(sqrt(avg(CAST(value AS DOUBLE) * value)), 6) AS rms FROM samples GROUP BY series_id")
def rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rms(samples(spark, sf_dir)).select("series_id", F.round("rms", 6).alias("rms"))


@query(""", moved AS (SELECT series_id, seq, CAST(CAST(value AS DOUBLE) - 50 AS FLOAT) AS value FROM samples),
    pairs AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS was FROM moved)
    SELECT series_id, CAST(sum(CASE WHEN (was < 0 AND value >= 0) OR (was >= 0 AND value < 0) THEN 1 ELSE 0 END) AS BIGINT) AS crossings FROM pairs GROUP BY series_id""")
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.zero_crossings(ops.map_samples(samples(spark, sf_dir), ops.offset(-50)), MINUTE).select("series_id", "crossings")


@query("SELECT CAST(1000 AS BIGINT) AS frequency_hz, 0.7071::DOUBLE AS rms", samples=False)
def sine_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = signal_samples(spark, Waveform.SINE, 1000.0, 20833, 4800)
    f = ops.zero_crossings(wave, 20833).join(ops.rms(wave), "series_id")
    return f.select((F.round(F.col("frequency_hz") / 10) * 10).cast("long").alias("frequency_hz"), F.round("rms", 4).alias("rms"))


@query("""SELECT series_id, CAST(sum(CASE WHEN CAST(value AS DOUBLE) <> seq THEN 1 ELSE 0 END) AS BIGINT) AS errors, min(CASE WHEN CAST(value AS DOUBLE) <> seq THEN seq END) AS first_error
    FROM samples GROUP BY series_id""")
def seq_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sequence_errors(samples(spark, sf_dir))


_LAG = ", pairs AS (SELECT *, t_ns - lag(t_ns) OVER (PARTITION BY series_id ORDER BY seq) AS d FROM samples)"


@query(_LAG + f" SELECT series_id, CAST(sum(CASE WHEN abs(d - {HOUR}) > {12 * HOUR} THEN 1 ELSE 0 END) AS BIGINT) AS gaps, max(d) AS longest_ns FROM pairs GROUP BY series_id")
def timing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.timing_gaps(samples(spark, sf_dir), HOUR, 12 * HOUR)


@query(_LAG + " SELECT series_id, round(avg(d), 0) AS avg_ns, min(d) AS min_ns, max(d) AS max_ns FROM pairs GROUP BY series_id")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latency(samples(spark, sf_dir)).withColumn("avg_ns", F.round("avg_ns", 0))


# Functions --------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN event_id WHEN 2 THEN event_id * 1000 WHEN 3 THEN event_id * 1000001 ELSE event_id * 1000000007 END AS t_ns FROM events)
    SELECT event_id, CASE WHEN t_ns = 0 THEN '---' WHEN t_ns // 1000000000 > 0 THEN printf('%d.%03ds', t_ns // 1000000000, t_ns // 1000000 % 1000)
        WHEN t_ns // 1000000 > 0 THEN printf('%d.%03dms', t_ns // 1000000, t_ns // 1000 % 1000) WHEN t_ns // 1000 > 0 THEN (t_ns // 1000) || 'μs' ELSE t_ns || 'ns' END AS shown,
        t_ns // 1000000000 AS sec, t_ns % 1000000000 AS nsec, CASE WHEN t_ns = 0 THEN 0 ELSE 1000000000 // t_ns END AS rate FROM t""", samples=False)
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    t = F.when(i % 5 == 0, 0).when(i % 5 == 1, i).when(i % 5 == 2, i * 1000).when(i % 5 == 3, i * 1_000_001).otherwise(i * 1_000_000_007).cast("long")
    rows = read(spark, sf_dir, "events").select("event_id", t.alias("t_ns"))
    parts = split_time(F.col("t_ns"))
    return rows.select("event_id", human_time(F.col("t_ns")).alias("shown"), parts["sec"].alias("sec"), parts["nsec"].alias("nsec"), period_to_rate(F.col("t_ns")).alias("rate"))


@query("SELECT DISTINCT event_type, translate('raw ' || event_type || ':1/2', '/:| ', '____') || '.txt' AS name FROM events", samples=False)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select("event_type", file_name(F.concat(F.lit("raw "), F.col("event_type"), F.lit(":1/2"))).alias("name"))


@query("SELECT l_orderkey, l_linenumber, format('{:.2f}', l_extendedprice) AS price FROM lineitem", samples=False)
def fixed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c_fixed(F.col("l_extendedprice"), 2).alias("price"))


# Extensions beyond the single-input operators ---------------------------------------------------------------------------


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One event type as a series on the hour grid, a sample per hour: the largest value."""
    rows = event_samples(read(spark, sf_dir, "events"), "event_type").where(F.col("series_id") == kind)
    hour = (floor_div(F.col("t_ns"), HOUR) * HOUR).alias("t_ns")
    out = rows.groupBy("series_id", hour).agg(F.max("value").alias("value"))
    return out.withColumn("seq", floor_div(F.col("t_ns"), HOUR))


_KINDS = f"""WITH hours AS (SELECT event_type AS series_id, epoch_us(ts) * 1000 // {HOUR} * {HOUR} AS t_ns, max(CAST(value AS FLOAT)) AS value FROM events GROUP BY 1, 2),
    a AS (SELECT * FROM hours WHERE series_id = 'click'), b AS (SELECT * FROM hours WHERE series_id = 'view') """


def _element(operation: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.elementwise(_kind(spark, sf_dir, "click"), _kind(spark, sf_dir, "view"), operation)

    run.__name__ = f"elementwise_{operation}"
    query(_KINDS + f"SELECT a.t_ns, CAST({sql} AS FLOAT) AS value FROM a JOIN b ON a.t_ns = b.t_ns", samples=False)(run)


_element("add", "CAST(a.value AS DOUBLE) + CAST(b.value AS DOUBLE)")
_element("subtract", "CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)")
_element("multiply", "CAST(a.value AS DOUBLE) * CAST(b.value AS DOUBLE)")
_element("ge", "CASE WHEN a.value >= b.value THEN 1.0 ELSE 0.0 END")


@query(_KINDS + "SELECT a.t_ns, a.value AS value_0, b.value AS value_1 FROM a JOIN b ON a.t_ns = b.t_ns", samples=False)
def time_window_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.time_window_sync([_kind(spark, sf_dir, "click"), _kind(spark, sf_dir, "view")])


@query(f"""WITH f AS (SELECT event_type, epoch_us(ts) * 1000 // {24 * HOUR} AS frame, min(epoch_us(ts) * 1000) AS t FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
    SELECT frame, max(t) - min(t) AS skew_ns FROM f GROUP BY frame HAVING count(*) = 2 AND max(t) - min(t) <= {HOUR}""", samples=False)
def skew_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_kinds = event_samples(read(spark, sf_dir, "events"), "event_type")
    return ops.skew_sync([all_kinds.where(F.col("series_id") == k) for k in ("click", "view")], 24 * HOUR, HOUR)


@query(_KINDS + "SELECT a.t_ns, a.value, b.value AS held FROM a ASOF LEFT JOIN b ON a.t_ns >= b.t_ns", samples=False)
def sample_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_and_hold(_kind(spark, sf_dir, "click"), _kind(spark, sf_dir, "view"), 24 * HOUR).select("t_ns", "value", "held")


@query(_KINDS + f""", ends AS (SELECT min(t_ns) AS lo, max(t_ns) AS hi FROM a), grid AS (SELECT unnest(range(lo, hi + 1, {HOUR})) AS t_ns FROM ends)
    SELECT grid.t_ns, a.value, a.t_ns <> grid.t_ns AS filled FROM grid ASOF JOIN a ON grid.t_ns >= a.t_ns""", samples=False)
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fill_gaps(_kind(spark, sf_dir, "click"), HOUR).select("t_ns", "value", "filled")


@query(""", ends AS (SELECT series_id, min(t_ns) AS lo, max(t_ns) AS hi FROM samples GROUP BY 1),
    grid AS (SELECT series_id, unnest(range((lo + 86399999999999) // 86400000000000 * 86400000000000, hi + 1, 86400000000000)) AS t_ns FROM ends),
    latest AS (SELECT series_id, t_ns, arg_max(value, seq) AS value FROM samples GROUP BY 1, 2)
    SELECT grid.series_id, grid.t_ns, latest.value FROM grid ASOF JOIN latest ON grid.series_id = latest.series_id AND grid.t_ns >= latest.t_ns""")
def regularize_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.regularize(samples(spark, sf_dir), 24 * HOUR)


@query("""SELECT series_id, seq, round(avg(CAST(value AS DOUBLE)) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS average FROM samples""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.moving_average(samples(spark, sf_dir), 5).select("series_id", "seq", F.round("average", 6).alias("average"))


@query(""", pairs AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS was FROM samples)
    SELECT series_id, seq, value FROM pairs WHERE was < 50 AND value >= 50""")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.edges(samples(spark, sf_dir), 50).select("series_id", "seq", "value")


@query(_KINDS + "SELECT t_ns, max(CASE WHEN series_id = 'click' THEN value END) AS click, max(CASE WHEN series_id = 'view' THEN value END) AS view FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY t_ns", samples=False)
def combine_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.combine_channels(_kind(spark, sf_dir, "click").unionByName(_kind(spark, sf_dir, "view")), ["click", "view"])


@query("""SELECT 'l_quantity' AS series_id, l_orderkey AS t_ns, CAST(l_quantity AS FLOAT) AS value FROM lineitem
    UNION ALL SELECT 'l_tax', l_orderkey, CAST(l_tax AS FLOAT) FROM lineitem""", samples=False)
def split_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("t_ns", F.col("l_orderkey"))
    return ops.split_channels(rows, ["l_quantity", "l_tax"])


@query(""", ends AS (SELECT series_id, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM samples GROUP BY 1)
    SELECT series_id, seq, CAST(-1.0::DOUBLE + coalesce((CAST(value AS DOUBLE) - lo) / CASE WHEN hi > lo THEN hi - lo END, 0.5::DOUBLE) * 2.0::DOUBLE AS FLOAT) AS value
    FROM samples JOIN ends USING (series_id)""")
def auto_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.auto_scale(samples(spark, sf_dir)).select("series_id", "seq", "value")


@query("SELECT 'signal' AS series_id, CAST(i AS BIGINT) AS batch_id, 250.0::DOUBLE AS frequency_hz FROM range(10) r(i)", samples=False)
def spectrum_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest frequency of frames of 128 samples of a 250 Hz wave."""
    wave = signal_samples(spark, Waveform.TRIANGLE, 250.0, 1_000_000, 1280)
    return ops.signal_to_noise(ops.power_spectrum(ops.to_batches(wave, 128))).select("series_id", "batch_id", "frequency_hz")
