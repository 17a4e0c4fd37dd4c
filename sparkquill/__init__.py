"""Retrieval and knowledge-base analytics on PySpark DataFrames."""
