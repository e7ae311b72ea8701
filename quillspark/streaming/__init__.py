"""Fitted transforms on streaming DataFrames."""
