"""Operators for preparing training data at scale, each one DataFrame in, DataFrame out."""
