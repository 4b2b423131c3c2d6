"""Planning: what is known of a stream, what operators require and promise, and graphs of operators."""

from .contracts import Behaviour, Constraint, Contract, check_alignment, check_connection, propagate
from .filters import Filter, connect
from .pipeline import Pipeline
from .properties import PROPERTIES, Properties, from_buffer, period_to_rate_hz, rate_to_period_ns

__all__ = [
    "Behaviour", "Constraint", "Contract", "check_alignment", "check_connection", "propagate", "Filter", "connect", "Pipeline",
    "PROPERTIES", "Properties", "from_buffer", "period_to_rate_hz", "rate_to_period_ns",
]
