"""eventloom: a Spark-native engine for cross-venue event studies."""

__version__ = "0.1.0"
