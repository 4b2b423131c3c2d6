"""Graphs of operators, which are operators themselves."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from ..model import BufferConfig, StreamError
from .contracts import check_connection, propagate
from .filters import MAX_INPUTS, Filter
from .properties import Properties

NO_SOURCE = "Pipeline has no data source. A pipeline without external inputs must contain at least one source filter to generate data."


class Pipeline(Filter):
    """Members, edges (from, port, to, port), one input and one output; made lazily into one plan."""

    def __init__(
        self, name: str, members: list[Filter], edges: list[tuple[Filter, int, Filter, int]], input_to: tuple[Filter, int] | None,
        output_of: tuple[Filter, int], buffer: BufferConfig | None = None,
    ):
        if not members or output_of is None:
            raise StreamError("NULL_POINTER", "a pipeline has members and an output")
        ends = [f for a, _, b, _ in edges for f in (a, b)] + [output_of[0]] + ([input_to[0]] if input_to else [])
        if any(f not in members for f in ends):
            raise StreamError("INVALID_CONFIG", "an edge leads to a filter that is no member")
        super().__init__(name, self._outputs, 1 if input_to else 0, 1, buffer or (input_to[0].buffer if input_to else output_of[0].buffer))
        self.members, self.edges, self.input_to, self.output_of = members, edges, input_to, output_of
        self.external: dict[int, tuple[Filter, int]] = {}
        for a, p, b, q in edges:
            a.sink_connect(p, b, q)

    def declare_external_input(self, index: int, to: Filter, port: int = 0) -> None:
        """Names the member port that an outer input leads to."""
        if not 0 <= index < MAX_INPUTS:
            raise StreamError("INVALID_CONFIG", f"external input {index}")
        if to not in self.members:
            raise StreamError("INVALID_CONFIG", f"{to.name} is no member")
        self.external[index] = (to, port)

    def order(self) -> list[Filter]:
        """Members, each after those that lead to it."""
        graph = TopologicalSorter({f: [] for f in self.members})
        for a, _, b, _ in self.edges:
            graph.add(b, a)
        try:
            return list(graph.static_order())
        except CycleError:
            raise StreamError("INVALID_CONFIG", "Pipeline contains a cycle") from None

    def validate(self, external: dict[int, Properties] | None = None) -> Properties:
        """Carries what is known through the graph and holds it against every contract; what is known of the output.

        External inputs are checked like edges, and the facts of all output ports are carried.
        """
        external = external or {}
        if not external and not self.input_to and all(f.n_inputs for f in self.members):
            raise StreamError("INVALID_CONFIG", NO_SOURCE)
        known: dict[tuple[Filter, int], Properties] = {}
        for f in self.order():
            inputs = [self._input(f, port, known, external) for port in range(f.n_inputs)]
            self._check_aligned(f, inputs)
            f.input_properties = dict(enumerate(inputs))
            for port in range(max(1, f.n_outputs)):
                known[f, port] = propagate(inputs, f.contract, port)
        return known[self.output_of]

    def _input(self, f: Filter, port: int, known: dict, external: dict[int, Properties]) -> Properties:
        for index, end in self.external.items():
            if end == (f, port) and index in external:
                check_connection(external[index], f.contract, port)
                return external[index]
        for a, p, b, q in self.edges:
            if (b, q) == (f, port):
                try:
                    check_connection(known[a, p], f.contract, port)
                except StreamError as e:
                    raise StreamError(e.code, f"{e.message} (Connection: {a.name}[{p}] -> {f.name}[{port}])") from None
                return known[a, p]
        if self.input_to == (f, port):
            if external:
                raise StreamError("INVALID_CONFIG", f"Pipeline input filter '{f.name}' port {port} is designated as pipeline input but no external input mapping was declared for it")
            return Properties()
        raise StreamError("INVALID_CONFIG", f"Filter '{f.name}' input port {port} has no upstream connection")

    @staticmethod
    def _check_aligned(f: Filter, inputs: list[Properties]) -> None:
        for c in f.contract.constraints:
            if c.op != "aligned":
                continue
            ports = [p for p in range(len(inputs)) if c.applies(p)]
            for p in ports[1:]:
                if inputs[p].get(c.name) != inputs[ports[0]].get(c.name):
                    what = f"Multi-input alignment constraint failed for property '{c.name}' on filter '{f.name}'"
                    raise StreamError("PROPERTY_MISMATCH", f"{what}: input port {p} differs from port {ports[0]}")

    def _outputs(self, *inputs: DataFrame) -> list[DataFrame]:
        made: dict[Filter, list[DataFrame]] = {}
        by_end = {(b, q): (a, p) for a, p, b, q in self.edges}
        for f in self.order():
            frames = []
            for port in range(f.n_inputs):
                if (f, port) in by_end:
                    a, p = by_end[f, port]
                    frames.append(made[a][p])
                elif self.input_to == (f, port) and inputs:
                    frames.append(inputs[0])
                else:
                    raise StreamError("NOINPUT", f"{f.name} has no input at port {port}")
            made[f] = f.outputs(*frames)
        return [made[self.output_of[0]][self.output_of[1]]]

    def start(self) -> None:
        """Marks members as running, in order; if one cannot, those before it are stopped."""
        super().start()
        begun = []
        try:
            for f in self.members:
                f.start()
                begun.append(f)
        except StreamError:
            for f in reversed(begun):
                f.stop()
            self.running = False
            raise

    def stop(self) -> None:
        for f in reversed(self.members):
            f.stop()
        super().stop()

    def describe(self) -> str:
        edges = [f"  {a.name}[{p}] -> {b.name}[{q}]" for a, p, b, q in self.edges]
        return "\n".join([f"Pipeline {self.name}: {len(self.members)} filters, {len(self.edges)} connections", *edges])
