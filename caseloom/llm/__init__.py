"""Operators for preparing language-model training data on Spark.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` holds the thin registered
queries that reduce an operator's output to digests.
"""
