"""Listening analytics on Spark: plain functions from DataFrame to DataFrame."""
