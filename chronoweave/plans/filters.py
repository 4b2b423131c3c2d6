"""Operators as nodes of a graph: a function of frames, an input buffer's settings, a contract, and lifecycle calls.

A node holds no data and no thread.  Starting one marks it; its frame is a lazy plan, and an action on the last node's frame runs
the whole graph as one Spark job.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..model import BufferConfig, Dtype, ErrorCode, StreamError
from ..sources.csv import CsvSource
from ..sources.signal import check_signal, signal_samples
from .contracts import Contract, check_alignment, check_connection, propagate
from .properties import Properties

MAX_SINKS, MAX_INPUTS, MAX_NAME = 10, 10, 31
UNBOUNDED = 2**32 - 1


class Health(Enum):
    HEALTHY = 0
    DEGRADED = 1
    FAILED = 2
    UNKNOWN = 3


class Filter:
    """A node: ``run`` takes the input frames, in the order of ports, and returns a list with one frame per output."""

    kind = "filter"

    def __init__(
        self, name: str, run: Callable[..., list[DataFrame] | DataFrame], n_inputs: int = 1, n_outputs: int = 1,
        buffer: BufferConfig | None = None, contract: Contract | None = None, timeout_us: int = 1_000_000,
    ):
        if not callable(run):
            raise StreamError("INVALID_CONFIG_WORKER", name)
        if not 0 <= n_inputs <= MAX_INPUTS:
            raise StreamError("INVALID_CONFIG_MAX_INPUTS", f"{n_inputs} inputs")
        if not 0 <= n_outputs <= MAX_SINKS:
            raise StreamError("INVALID_CONFIG_MAX_SINKS", f"{n_outputs} outputs")
        if timeout_us < 0:
            raise StreamError("INVALID_CONFIG_TIMEOUT", f"{timeout_us} us")
        self.name, self.run, self.n_inputs, self.n_outputs = name[:MAX_NAME], run, n_inputs, n_outputs
        self.buffer, self.contract, self.timeout_us = buffer or BufferConfig(), contract or Contract(), timeout_us
        self.sinks: dict[int, tuple[Filter, int]] = {}
        self.sources: dict[int, tuple[Filter, int]] = {}
        self.input_properties: dict[int, Properties] = {}
        self.running, self.error = False, ErrorCode.OK

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.name})"

    # Wiring ---------------------------------------------------------------------------------------------------------

    def sink_connect(self, port: int, sink: Filter, sink_port: int = 0) -> None:
        """Connects an output to an input: the port has to be free and the types equal; contracts are not looked at."""
        self.validate_connection(port)
        if not 0 <= sink_port < sink.n_inputs:
            raise StreamError("INVALID_SINK_IDX", f"{sink.name} has no input {sink_port}")
        if port in self.sinks or sink_port in sink.sources:
            raise StreamError("CONNECTION_OCCUPIED", f"{self.name}[{port}] -> {sink.name}[{sink_port}]")
        if self.n_inputs and self.buffer.dtype != sink.buffer.dtype:
            raise StreamError("DTYPE_MISMATCH", f"{self.name} has {self.buffer.dtype.name}, {sink.name} {sink.buffer.dtype.name}")
        self.sinks[port], sink.sources[sink_port] = (sink, sink_port), (self, port)

    def sink_disconnect(self, port: int) -> None:
        if port not in self.sinks:
            raise StreamError("NO_SINK", f"{self.name}[{port}]")
        sink, sink_port = self.sinks.pop(port)
        del sink.sources[sink_port]
        sink.input_properties.pop(sink_port, None)

    def validate_connection(self, port: int) -> None:
        if not 0 <= port < self.n_outputs:
            raise StreamError("INVALID_SINK_IDX", f"{self.name} has no output {port}")

    def output_properties(self, port: int = 0) -> Properties:
        """What is known of an output, from what is known of the inputs."""
        known = [self.input_properties.get(p, Properties()) for p in range(self.n_inputs)]
        return propagate(known, self.contract, port)

    # Running --------------------------------------------------------------------------------------------------------

    def frames(self, made: dict[Filter, list[DataFrame]] | None = None) -> list[DataFrame]:
        """The output frames; nodes upstream are asked for theirs once each."""
        made = {} if made is None else made
        if self not in made:
            missing = [p for p in range(self.n_inputs) if p not in self.sources]
            if missing:
                raise StreamError("NOINPUT", f"{self.name} has no input at port {missing[0]}")
            inputs = [self.sources[p][0].frames(made)[self.sources[p][1]] for p in range(self.n_inputs)]
            made[self] = self.outputs(*inputs)
        return made[self]

    def outputs(self, *inputs: DataFrame) -> list[DataFrame]:
        try:
            out = self.run(*inputs)
        except StreamError as e:
            self.error = e.code
            raise
        return out if isinstance(out, list) else [out] * max(1, self.n_outputs)

    def start(self) -> None:
        if self.running:
            raise StreamError("ALREADY_RUNNING", self.name)
        self.running = True

    def stop(self) -> None:
        self.running = False

    def flush(self) -> None:
        """Nothing is held back: a frame is complete."""

    def drain(self) -> None:
        """Nothing is in flight: see flush."""

    def reset(self) -> None:
        self.error = ErrorCode.OK

    def deinit(self) -> None:
        self.stop()
        for port in list(self.sinks):
            self.sink_disconnect(port)

    # Looking at it --------------------------------------------------------------------------------------------------

    def stats(self, df: DataFrame) -> DataFrame:
        """Batches and samples that went through, per series."""
        return ops.counters(df, self.buffer.capacity)

    def health(self) -> Health:
        return Health.HEALTHY if self.error is ErrorCode.OK else Health.FAILED

    def backlog(self) -> int:
        """Frames are pulled, so no input waits."""
        return 0

    def reconfigure(self, **_settings) -> None:
        raise StreamError("NOT_IMPLEMENTED", self.name)

    def handle_error(self, code: ErrorCode) -> None:
        self.error = code

    def recover(self) -> None:
        self.error = ErrorCode.OK

    def describe(self) -> str:
        edges = [f"  out {p} -> {sink.name}[{q}]" for p, (sink, q) in sorted(self.sinks.items())]
        return "\n".join([f"{type(self).__name__} {self.name}: {self.n_inputs} inputs, {self.n_outputs} outputs", *edges])

    def dump_state(self) -> str:
        return f"{self.describe()}\n  running {self.running}, error {self.error.name}, health {self.health().name}"


def connect(source: Filter, port: int, sink: Filter, sink_port: int = 0, checked: bool = True) -> None:
    """Connects nodes; ``checked`` first holds what is known of the output against the input's contract."""
    if checked:
        known = source.output_properties(port)
        check_connection(known, sink.contract, sink_port)
        check_alignment(sink.contract, sink.input_properties, sink_port, known)
        sink.input_properties[sink_port] = known
    source.sink_connect(port, sink, sink_port)


# Nodes of the operators ---------------------------------------------------------------------------------------------


def csv_source(spark: SparkSession, name: str, source: CsvSource) -> Filter:
    """One output per data column; sizes of batches and the period are not known before the file is read."""
    contract = Contract().promise("data_type", "set", source.dtype).promise("min_batch_capacity", "set", 1)
    contract.promise("max_batch_capacity", "set", UNBOUNDED).promise("sample_period_ns", "set", None)

    def run() -> list[DataFrame]:
        rows = source.read(spark)
        return [rows.where(F.col("series_id") == c) for c in source.data_columns]

    # More columns than the usual outputs are read, up to the source's own limit.
    node = Filter(name, run, 0, min(len(source.data_columns), MAX_SINKS), BufferConfig(source.dtype), contract)
    node.n_outputs = len(source.data_columns)
    return node


def signal_generator(spark: SparkSession, name: str, buffer: BufferConfig | None = None, **settings) -> Filter:
    buffer = buffer or BufferConfig()
    check_signal(settings["kind"], settings["frequency_hz"], settings["period_ns"], settings.get("allow_aliasing", False))
    contract = Contract().promise("data_type", "set", Dtype.FLOAT).promise("sample_period_ns", "set", settings["period_ns"])
    contract.promise("min_batch_capacity", "set", buffer.capacity).promise("max_batch_capacity", "set", buffer.capacity)
    if settings.get("max_samples"):
        contract.promise("max_total_samples", "set", settings["max_samples"])
    return Filter(name, lambda: signal_samples(spark, **settings), 0, MAX_SINKS, buffer, contract)


def map_filter(name: str, *functions, buffer: BufferConfig | None = None) -> Filter:
    buffer = buffer or BufferConfig()
    contract = Contract().accept_buffer(buffer).promise("data_type", "set", buffer.dtype).promise("sample_period_ns", "preserve")
    contract.promise("min_batch_capacity", "set", 1).promise("max_batch_capacity", "set", buffer.capacity)
    return Filter(name, lambda df: ops.map_samples(df, *functions, dtype=buffer.dtype), buffer=buffer, contract=contract)


def passthrough_filter(name: str, buffer: BufferConfig | None = None) -> Filter:
    buffer = buffer or BufferConfig()
    return Filter(name, ops.passthrough, buffer=buffer, contract=Contract().accept_buffer(buffer).keep_stream())


def tee_filter(name: str, outputs: list[BufferConfig], buffer: BufferConfig | None = None, keep: bool = False) -> Filter:
    buffer = buffer or BufferConfig()
    if not 2 <= len(outputs) <= MAX_SINKS:
        raise StreamError("INVALID_CONFIG", f"a tee has 2 to {MAX_SINKS} outputs")
    run = lambda df: ops.tee(df, len(outputs), buffer, outputs, keep)
    for out in outputs:
        if out.dtype != buffer.dtype:
            raise StreamError("TYPE_MISMATCH", name)
        if out.capacity != buffer.capacity:
            raise StreamError("CAPACITY_MISMATCH", name)
    return Filter(name, run, 1, len(outputs), buffer, Contract().accept_buffer(buffer).keep_stream())


def batch_matcher(name: str, period_ns: int, size: int | None = None, buffer: BufferConfig | None = None) -> Filter:
    """Frames of ``size`` samples, or as many as a batch of the connected sink holds."""
    buffer = buffer or BufferConfig()
    contract = Contract().accept_buffer(buffer).require("sample_period_ns", "exists")
    contract.promise("data_type", "preserve").promise("sample_period_ns", "preserve")
    node = Filter(name, lambda df: df, buffer=buffer, contract=contract)

    def run(df: DataFrame) -> DataFrame:
        frame = size or (node.sinks[0][0].buffer.capacity if 0 in node.sinks else None)
        if frame is None:
            raise StreamError("NO_SINK", f"{name} takes its size from a sink")
        return ops.match_frames(ops.check_phase(df, period_ns), period_ns, frame)

    node.run = run
    return node


def sample_aligner(name: str, period_ns: int, strategy: str = "nearest", method: str = "nearest", buffer: BufferConfig | None = None) -> Filter:
    buffer = buffer or BufferConfig()
    contract = Contract().accept_buffer(buffer).require("sample_period_ns", "exists").keep_stream(adaptive=method != "nearest")
    return Filter(name, lambda df: ops.align(df, period_ns, strategy, method), buffer=buffer, contract=contract)


def csv_sink(name: str, write: Callable[[DataFrame], DataFrame], buffer: BufferConfig | None = None) -> Filter:
    contract = Contract().require("data_type", "eq", Dtype.FLOAT).require("sample_period_ns", "exists")
    return Filter(name, write, 1, 0, buffer, contract)


def debug_output(name: str, buffer: BufferConfig | None = None) -> Filter:
    buffer = buffer or BufferConfig()
    return Filter(name, ops.passthrough, buffer=buffer, contract=Contract().accept_buffer(buffer).keep_stream())
