"""The metrics: every operator takes DataFrames and returns a lazy DataFrame."""
