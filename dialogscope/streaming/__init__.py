"""Incremental (Structured Streaming) refresh of the dashboard counters."""
