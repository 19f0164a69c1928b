"""Korean text analytics on Spark: Hangul functions, search, similarity ranking and tuning as DataFrame operations."""
