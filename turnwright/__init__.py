"""Turn-aware data preparation and reward scoring on Spark DataFrames."""
