"""Operators for building language-model training corpora on Spark.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; ``entries.py`` registers the queries.
"""
