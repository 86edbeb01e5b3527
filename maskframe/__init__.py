"""Masked tables, integer tensors and fixed-point analytics as Spark DataFrames."""
