"""hourglass: short-horizon forecasting on panels of regular time series, on Spark.

The canonical data model is the LONG panel ``(series STRING, ts TIMESTAMP,
value DOUBLE)``; every public function maps DataFrames to DataFrames and is
planned by Catalyst.
"""

__version__ = "0.1.0"
