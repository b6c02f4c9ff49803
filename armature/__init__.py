"""Robot-demonstration data on Spark: every operator takes and returns DataFrames."""
