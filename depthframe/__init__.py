"""Read-depth analytics over linearized sequence graphs, on Spark DataFrames."""
