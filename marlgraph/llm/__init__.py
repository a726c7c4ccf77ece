"""Operators for texts and vectors of training data. Nothing outside this package imports it."""
