"""Operators that a pipeline for training data needs; nothing else in the library imports them."""
