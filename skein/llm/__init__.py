"""Operators for training data made of code and text. Nothing outside this package imports it."""
