"""Analytics for scheduled transport networks on Spark DataFrames."""
