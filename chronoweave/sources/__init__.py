"""Sources: delimited text, waveforms, patterns, and the event table."""

from .csv import CsvSource, discover_header, parse_lines
from .generators import Pattern, event_samples, function_samples, pattern_samples, variable_batches
from .signal import Waveform, signal_samples

__all__ = [
    "CsvSource", "discover_header", "parse_lines", "Pattern", "event_samples", "function_samples", "pattern_samples", "variable_batches",
    "Waveform", "signal_samples",
]
