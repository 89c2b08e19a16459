"""Operators of a large-scale training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames, processes
whole texts and whole tables, and keeps its own general interface; the thin ``opN_<name>`` queries
in ``queries.py`` derive their digest columns from it.
"""
