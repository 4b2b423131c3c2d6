"""Timed telemetry and signal data as Spark DataFrames: sources, operators, contracts, pipelines and sinks."""
