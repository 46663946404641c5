"""Calibrated scoring, threshold decisions, monitoring and ranking on Spark DataFrames."""
