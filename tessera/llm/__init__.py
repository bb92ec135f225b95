"""Operators for training data: ten stages of a corpus pipeline, each a DataFrame function."""
