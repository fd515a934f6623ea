"""Operators over event time."""
