"""twinscope: compare a real table with synthetic copies of it, on Spark.

Every operator takes DataFrames and returns a DataFrame.  See README.md for the map of
operators and ``twinscope.registry`` for one runnable query per operator.
"""

from twinscope.frames import TablePair, UnsupportedColumn, null_nan

__all__ = ["TablePair", "UnsupportedColumn", "null_nan"]
