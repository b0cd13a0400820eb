"""Device-fleet telemetry analytics on Spark DataFrames, Spark ML and Structured Streaming."""
