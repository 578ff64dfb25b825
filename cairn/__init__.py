"""Point-cloud, trajectory and log analytics on Spark DataFrames."""
