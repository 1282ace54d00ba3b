"""Streams: ingest, running statistics, per-vehicle speed, windows, change sets and games."""
