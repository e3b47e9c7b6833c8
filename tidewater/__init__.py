"""Analytics over time-ordered records on Spark DataFrames."""
