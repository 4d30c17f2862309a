"""Operators over event sequences and text for model training. Nothing else in the library imports this package."""
