"""Operators for training-data preparation: filtering, duplicates, privacy, tokens and packing."""
