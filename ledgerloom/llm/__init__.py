"""Operators of a training-data pipeline over `documents`, `pages`, `benchmark` and `labels`."""
