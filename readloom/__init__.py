"""Read-set, overlap and work-tracking analytics on Spark DataFrames."""

__version__ = "0.1.0"
