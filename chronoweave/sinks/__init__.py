"""Sinks: delimited text, debug text, and a checking consumer."""

from .csv import CsvFormat, csv_frame, csv_lines, header_line, size_limited, write_lines
from .debug import DebugFormat, debug_lines
from .printing import buffer_summary, describe_buffer

__all__ = ["CsvFormat", "csv_frame", "csv_lines", "header_line", "size_limited", "write_lines", "DebugFormat", "debug_lines", "buffer_summary", "describe_buffer"]
