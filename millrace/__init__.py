"""Spark-native analytics over the star schema: DataFrames in, DataFrames out."""
