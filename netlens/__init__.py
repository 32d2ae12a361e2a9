"""netlens: analysis of request/response traffic on Spark DataFrames and Structured Streaming."""
