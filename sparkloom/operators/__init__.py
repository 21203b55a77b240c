"""Relational shapes that Spark's SQL lacks, as functions on DataFrames."""
