"""Daily-bar market analytics on Spark: pure functions from DataFrame to DataFrame."""
