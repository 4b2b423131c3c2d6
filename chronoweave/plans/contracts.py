"""What an operator requires of its inputs and does to what is known of its outputs."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..model import BufferConfig, Dtype, StreamError
from .properties import PROPERTIES, Properties

#: Constraints and behaviours of one operator at most; any port.
MOST, ALL = 16, None


def _text(value) -> str:
    return str(int(value))


@dataclass(frozen=True)
class Constraint:
    """A requirement on inputs: ``exists``, ``eq``, ``gte``, ``lte``, or ``aligned`` (equal over all of ``ports``)."""

    name: str
    op: str
    operand: int | Dtype | None = None
    ports: frozenset[int] | None = ALL

    def __post_init__(self):
        if self.name not in PROPERTIES or self.op not in ("exists", "eq", "gte", "lte", "aligned"):
            raise StreamError("INVALID_CONFIG", f"no constraint {self.op} on {self.name}")
        if self.op in ("eq", "gte", "lte") and self.operand is None:
            raise StreamError("INVALID_CONFIG", f"constraint {self.op} on {self.name} needs a value")

    def applies(self, port: int) -> bool:
        return self.ports is None or port in self.ports

    def failure(self, given: Properties) -> str | None:
        """What is wrong with an input, or None.  An unknown fact fails everything but ``aligned``, which is looked at elsewhere."""
        value, want = given.get(self.name), self.operand
        if self.op == "aligned":
            return None
        if value is None:
            tail = {"exists": None, "eq": "equal specific value", "gte": f"be >= {want}", "lte": f"be <= {want}"}[self.op]
            return f"Required property '{self.name}' is not present" if tail is None else f"Property '{self.name}' is not present but must {tail}"
        if self.op == "eq" and value != want:
            kind = "Data type" if self.name == "data_type" else f"Property '{self.name}'"
            return f"{kind} mismatch: expected {_text(want)}, got {_text(value)}"
        if self.op == "gte" and value < want:
            return f"Property '{self.name}' ({value}) is less than required minimum ({want})"
        if self.op == "lte" and value > want:
            return f"Property '{self.name}' ({value}) is greater than required maximum ({want})"
        return None


@dataclass(frozen=True)
class Behaviour:
    """What happens to a fact of the outputs: ``set`` to a value (None: unknown) or ``preserve`` from input ``source``."""

    name: str
    op: str
    value: int | Dtype | None = None
    source: int = 0
    ports: frozenset[int] | None = ALL

    def __post_init__(self):
        if self.name not in PROPERTIES or self.op not in ("set", "preserve"):
            raise StreamError("INVALID_CONFIG", f"no behaviour {self.op} on {self.name}")

    def applies(self, port: int) -> bool:
        return self.ports is None or port in self.ports

    def apply(self, inputs: list[Properties], out: Properties) -> Properties:
        if self.op == "set":
            return out.with_value(self.name, self.value)
        if not inputs:
            return out
        source = inputs[self.source if self.source < len(inputs) else 0]
        return out.with_value(self.name, source.get(self.name))


@dataclass
class Contract:
    """Constraints and behaviours, at most ``MOST`` of each, and for a port one behaviour of a fact."""

    constraints: list[Constraint] = field(default_factory=list)
    behaviours: list[Behaviour] = field(default_factory=list)

    def require(self, name: str, op: str, operand=None, ports=ALL) -> Contract:
        if len(self.constraints) >= MOST:
            raise StreamError("INVALID_CONFIG", f"more than {MOST} constraints")
        self.constraints.append(Constraint(name, op, operand, None if ports is None else frozenset(ports)))
        return self

    def promise(self, name: str, op: str, value=None, source: int = 0, ports=ALL) -> Contract:
        if len(self.behaviours) >= MOST:
            raise StreamError("INVALID_CONFIG", f"more than {MOST} behaviours")
        new = Behaviour(name, op, value, source, None if ports is None else frozenset(ports))
        for old in self.behaviours:
            if old.name == name and (old.ports is None or new.ports is None or old.ports & new.ports):
                raise StreamError("INVALID_CONFIG", f"two behaviours of {name} for one port")
        self.behaviours.append(new)
        return self

    def accept_buffer(self, config: BufferConfig, partial: bool = True) -> Contract:
        """Requires what an input buffer can take: its type, and batches that fit (or, not ``partial``, fill it exactly)."""
        self.require("data_type", "eq", config.dtype)
        if partial:
            return self.require("min_batch_capacity", "gte", 1).require("max_batch_capacity", "lte", config.capacity)
        return self.require("min_batch_capacity", "eq", config.capacity).require("max_batch_capacity", "eq", config.capacity)

    def keep_stream(self, config: BufferConfig | None = None, adaptive: bool = False, guarantee: bool = False) -> Contract:
        """Promises the input's type and period; batch sizes as they come, as the buffer's (``guarantee``), or nothing (``adaptive``)."""
        self.promise("data_type", "preserve").promise("sample_period_ns", "preserve")
        for name in () if adaptive else ("min_batch_capacity", "max_batch_capacity"):
            self.promise(name, "set", config.capacity) if guarantee and config else self.promise(name, "preserve")
        return self


def check_connection(given: Properties, contract: Contract, port: int = 0) -> None:
    """Raises PROPERTY_MISMATCH with the first failing constraint on a port."""
    for c in contract.constraints:
        if c.applies(port) and (wrong := c.failure(given)):
            raise StreamError("PROPERTY_MISMATCH", wrong)


def check_alignment(contract: Contract, inputs: dict[int, Properties], port: int, given: Properties) -> None:
    """Raises PROPERTY_MISMATCH if a fact that has to be aligned is unknown, or differs from a connected port of a lower number."""
    for c in contract.constraints:
        if c.op != "aligned" or not c.applies(port):
            continue
        start = "Multi-input alignment failed: "
        value = given.get(c.name)
        if value is None:
            raise StreamError("PROPERTY_MISMATCH", f"{start}property '{c.name}' is not known in new input (port {port})")
        for other in sorted(p for p in inputs if p < port and c.applies(p)):
            theirs = inputs[other].get(c.name)
            if theirs is None:
                raise StreamError("PROPERTY_MISMATCH", f"{start}property '{c.name}' is not known in existing input (port {other})")
            if theirs != value:
                what = {"data_type": "data type", "sample_period_ns": "sample period"}.get(c.name, f"property '{c.name}'")
                unit = " ns" if c.name == "sample_period_ns" else ""
                pair = f"port {port} ({_text(value)}{unit}) and port {other} ({_text(theirs)}{unit})"
                raise StreamError("PROPERTY_MISMATCH", f"{start}{what} mismatch between {pair}")


def propagate(inputs: list[Properties], contract: Contract, port: int = 0) -> Properties:
    """What is known of an output: the first input's facts, changed by the behaviours in turn; of a source only what it sets."""
    out = inputs[0] if inputs else Properties()
    for b in contract.behaviours:
        if b.applies(port):
            out = b.apply(inputs, out)
    return out
