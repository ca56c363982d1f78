"""Maintenance work-order analytics on Spark.

Every public function takes and returns DataFrames or Columns, so the calls
compose with ``DataFrame.transform`` and leave the physical plan to Spark.
"""

__version__ = "0.1.0"
