"""Operators for large-scale training-data preparation.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface, the thin ``opN_*`` query over the synthetic tables
and, where SQL can express the result, the DuckDB text of the same query.
"""
