"""Multi-label feature ranking on Spark DataFrames."""
