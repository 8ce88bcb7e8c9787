"""Operators for preparing training data."""
