"""Operators over DataFrames: joins, aggregates, windows, duplicates, graphs, diffs, policies."""
