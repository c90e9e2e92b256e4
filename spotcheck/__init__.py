"""Broadcast-advertising verification and text-corpus preparation on Spark DataFrames."""
