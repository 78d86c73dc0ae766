"""Batch text analytics over social posts, written as Spark DataFrame functions.

Every function takes DataFrames or Columns and returns DataFrames or Columns. The
session belongs to the caller, nothing is started or stopped here.
"""

__version__ = "0.1.0"
