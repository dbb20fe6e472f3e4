"""Point-in-time facts on Spark: every operator takes and returns DataFrames."""
