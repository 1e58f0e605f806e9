"""Credential detection, masking and training-data operators, written for Spark DataFrames."""
