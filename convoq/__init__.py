"""Conversation analytics on Spark DataFrames."""
