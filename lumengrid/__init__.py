"""Image, signal and table analytics on Spark DataFrames."""
