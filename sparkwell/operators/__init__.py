"""Relational, statistical, time-series, graph, text and vector operators on DataFrames."""
