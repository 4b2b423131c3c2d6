"""Structured Streaming variants: sources, the run fold with its state, and fan-out of a stream."""

from .streams import event_time_frames, fan_out, file_samples, looped_source, map_stream, run_stream, signal_stream

__all__ = ["event_time_frames", "fan_out", "file_samples", "looped_source", "map_stream", "run_stream", "signal_stream"]
