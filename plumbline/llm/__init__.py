"""Operators for large-scale training-data pipelines, each usable on any DataFrame of the right shape."""
