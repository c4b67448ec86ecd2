"""Operators for building training data sets; nothing else in the library imports this."""
