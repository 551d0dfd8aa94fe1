"""Operators for training-data pipelines over text: duplicates, secrets, packing, mixing, reading level."""
