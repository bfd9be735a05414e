"""Market and sensor analytics as plain functions on Spark DataFrames."""
