"""cutloom: a Spark-native index of timed media segments and the data operators around it."""

__version__ = "0.1.0"
