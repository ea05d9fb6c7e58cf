"""Operators on DataFrames: keyed joins, statistics, overlap, scoring, assignment."""
