"""Operators: functions from frames to frames.  Nothing here runs a job by itself unless its text says so."""

from .batching import RunFold, frame_stamps, regular_batches, runs_of, sample_times, to_batches
from .elementwise import cast_samples, failing, fold_samples, identity, low_pass, map_blocks, map_samples, offset, passthrough, remove_dc, scale
from .framing import align, align_regular, align_stats, check_phase, grid_time, match_frames, match_stamps, match_stats
from .joins import combine_channels, elementwise, fill_gaps, regularize, sample_and_hold, skew_sync, split_channels, time_window_sync
from .order import first_rows, with_previous, with_seq
from .routing import drop_stats, limit_samples, load_balance, overflow, overlap_batches, round_robin, route, tee, tee_union, write_counts
from .spectrum import auto_scale, power_spectrum, signal_to_noise
from .stats import counters, edges, latency, moving_average, rms, sequence_errors, timing_gaps, zero_crossings

__all__ = [
    "RunFold", "frame_stamps", "regular_batches", "runs_of", "sample_times", "to_batches",
    "cast_samples", "failing", "fold_samples", "identity", "low_pass", "map_blocks", "map_samples", "offset", "passthrough", "remove_dc", "scale",
    "align", "align_regular", "align_stats", "check_phase", "grid_time", "match_frames", "match_stamps", "match_stats",
    "combine_channels", "elementwise", "fill_gaps", "regularize", "sample_and_hold", "skew_sync", "split_channels", "time_window_sync",
    "first_rows", "with_previous", "with_seq",
    "drop_stats", "limit_samples", "load_balance", "overflow", "overlap_batches", "round_robin", "route", "tee", "tee_union", "write_counts",
    "auto_scale", "power_spectrum", "signal_to_noise",
    "counters", "edges", "latency", "moving_average", "rms", "sequence_errors", "timing_gaps", "zero_crossings",
]
