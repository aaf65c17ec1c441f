"""Operators of a training-data pipeline over ``documents``-like tables.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; per-row Python stays inside Arrow batches, and tables that
are read twice are written to the session's shared checkpoint folder.
"""
