"""What is known of a stream while planning: facts that are known or not, never data."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from ..model import BufferConfig, Dtype

# The facts, in order.
PROPERTIES = (
    "data_type", "min_batch_capacity", "max_batch_capacity", "sample_period_ns", "min_throughput_hz", "max_throughput_hz", "max_total_samples",
)


@dataclass(frozen=True)
class Properties:
    """Facts about a stream; None is unknown."""

    data_type: Dtype | None = None
    min_batch_capacity: int | None = None
    max_batch_capacity: int | None = None
    sample_period_ns: int | None = None
    min_throughput_hz: int | None = None
    max_throughput_hz: int | None = None
    max_total_samples: int | None = None

    def get(self, name: str):
        return getattr(self, name)

    def known(self, name: str) -> bool:
        return getattr(self, name) is not None

    def with_value(self, name: str, value) -> Properties:
        return replace(self, **{name: value})

    def describe(self) -> str:
        """The known facts, one a line."""
        known = [(f.name, getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) is not None]
        return "\n".join(["Property Table:", *(f"  {name}: {int(value)}" for name, value in known)])


def from_buffer(config: BufferConfig) -> Properties:
    """The facts that a buffer's settings fix."""
    return Properties(data_type=config.dtype, min_batch_capacity=config.capacity, max_batch_capacity=config.capacity)


def rate_to_period_ns(rate_hz: int) -> int:
    return 1_000_000_000 // rate_hz if rate_hz else 0


def period_to_rate_hz(period_ns: int) -> int:
    return 1_000_000_000 // period_ns if period_ns else 0
