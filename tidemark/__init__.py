"""tidemark: a PySpark-native engine for feeds that arrive late, twice and out of order."""

__version__ = "0.1.0"
