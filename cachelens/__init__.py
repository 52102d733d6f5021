"""Cache-workload analytics on Spark DataFrames."""
