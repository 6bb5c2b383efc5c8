"""Waymark: building, curating and scoring geographic retrieval datasets with Spark DataFrames."""
