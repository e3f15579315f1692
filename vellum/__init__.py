"""Conformance and corpus analytics on Spark DataFrames."""
