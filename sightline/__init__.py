"""Event-window and trajectory analytics on Spark DataFrames."""
