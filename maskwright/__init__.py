"""Spark-native text anonymisation: detect, merge, propagate, resolve, rewrite."""

__version__ = "0.1.0"
