"""Communities, leaders and corpus preparation on Spark DataFrames."""
