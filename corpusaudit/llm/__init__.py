"""Operators for large training-data pipelines, each on its own; nothing outside this folder imports them."""
