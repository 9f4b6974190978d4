"""tidewright: a PySpark-native engine for reply-linked message tables and text corpora."""

__version__ = "0.1.0"
