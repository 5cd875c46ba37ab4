"""Spark-native preprocessing of sequencing reads."""

__version__ = "0.1.0"
