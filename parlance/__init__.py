"""Interval, transcript, vector and text analytics on Spark DataFrames."""
