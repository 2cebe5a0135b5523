"""scholium: a Spark-native engine for ingesting, searching and measuring a corpus of papers."""

__version__ = "0.1.0"
