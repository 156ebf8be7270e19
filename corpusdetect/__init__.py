"""Spark-native corpora of human-written and machine-generated code.

Every public operator takes DataFrames (or Columns) and returns them; nothing
is evaluated until the caller acts, except where a docstring says that a small
table is materialised first.
"""

__version__ = "0.1.0"
