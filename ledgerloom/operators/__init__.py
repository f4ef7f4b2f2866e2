"""The workpaper operators: each takes DataFrames and returns one DataFrame."""
