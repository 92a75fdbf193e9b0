"""Operators for building text training data; nothing outside this package imports it."""
