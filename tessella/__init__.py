"""tessella: spatial-object and feature-table analytics as Spark DataFrame functions.

Operators are plain functions from DataFrames (or Columns) to DataFrames (or Columns); planning,
shuffling, spilling and vectorised execution are left to Catalyst, AQE and Arrow.
"""
