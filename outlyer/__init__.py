"""Active anomaly discovery and table analytics on Spark DataFrames."""
