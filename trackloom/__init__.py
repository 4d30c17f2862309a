"""Trackloom: Spark-first analytics for many ordered tracks, interval labels and event sequences."""

__version__ = "0.1.0"
