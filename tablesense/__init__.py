"""Declarative analytics over mixed sources, on Spark DataFrames."""
