"""Incremental jobs: ingest and sweeps as AvailableNow streams."""
