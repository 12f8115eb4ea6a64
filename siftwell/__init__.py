"""siftwell: indexed regex search and text processing on Spark DataFrames."""
