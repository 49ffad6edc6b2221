"""Keyloom: keyspace analytics on Spark DataFrames."""
