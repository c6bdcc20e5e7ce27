"""Operators that prepare text corpora for language-model training.

Nothing outside this package imports it.  Each operator takes and returns
DataFrames; ``registry`` holds the queries that apply them to the corpus tables.
"""
