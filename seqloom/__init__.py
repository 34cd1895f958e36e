"""Labelled-sequence analytics on Spark."""
