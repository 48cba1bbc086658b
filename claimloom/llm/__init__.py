"""Operators for training-text data; nothing outside this package imports it."""
