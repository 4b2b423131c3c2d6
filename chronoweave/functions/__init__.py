"""Column functions: number formats, bit patterns, time and rate conversions."""

from .formats import bits32, c_fixed, file_name, float_bits, hex32, human_time, narrow, now_ns, number_text, period_to_rate, rate_to_period, split_time
from .whole import ceil_div, floor_div

__all__ = [
    "bits32", "c_fixed", "ceil_div", "floor_div", "file_name", "float_bits", "hex32", "human_time", "narrow", "now_ns", "number_text", "period_to_rate", "rate_to_period", "split_time",
]
