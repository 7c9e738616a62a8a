"""Neural recordings, tracking and event data as Spark DataFrames."""
