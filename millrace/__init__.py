"""Record-processing engine on Spark DataFrames."""
