"""Structured Streaming: windows, dedup, change application, connectors."""
