"""A buffer's settings and what went through it, as text for people."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import BufferConfig
from ..operators.routing import drop_stats, overflow


def describe_buffer(name: str, config: BufferConfig) -> str:
    return f"{name}: {config.dtype.name}, {config.slots} usable slots of {config.capacity} samples, overflow {config.overflow.value}"


def buffer_summary(name: str, config: BufferConfig, batches: DataFrame, show: int = 20) -> str:
    """Totals over all series and the first slots of what the buffer holds; a few rows go to the driver."""
    total = drop_stats(batches, config).selectExpr("sum(batches) batches", "sum(dropped) dropped").first()
    n, lost = total.batches or 0, total.dropped or 0
    lines = [describe_buffer(name, config), f"total {n}, dropped {lost}, drop rate {100.0 * lost / n if n else 0.0:.1f}%"]
    held = overflow(batches, config).orderBy("series_id", "batch_id").select("series_id", "batch_id", "t_ns").limit(show).collect()
    lines += [f"[{i}] {r.series_id} batch {r.batch_id} at {r.t_ns} ns" for i, r in enumerate(held)]
    return "\n".join(lines)
