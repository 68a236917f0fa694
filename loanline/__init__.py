"""Credit-scoring data engine on Spark DataFrames, MLlib and Structured Streaming."""
