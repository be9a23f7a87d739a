"""Readers of the formats that literature connectors and benchmarks use, from saved responses and files."""
