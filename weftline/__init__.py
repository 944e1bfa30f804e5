"""weftline: token-stream preparation, request scoring and run analytics on Spark DataFrames."""
