"""readlake: reading analytics on Spark DataFrames."""
