"""Analytics over recorded conversations on Spark DataFrames."""
