"""Spark-first retail marts, data quality and corpus preparation on DataFrames."""
