"""roadflow: Spark-native analytics for hourly traffic observations.

Everything here is expressed with the DataFrame API so Catalyst can push
filters and projections into the scan, fuse expressions with whole-stage
codegen and choose join/aggregate strategies at runtime (AQE).
"""

__version__ = "0.1.0"
