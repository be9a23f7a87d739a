"""Whole runs: sinks, digests and reports built from operators."""
