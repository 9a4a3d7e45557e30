"""sievework: a PySpark-native engine for compacting, storing, retrieving and auditing text payloads."""

__version__ = "0.1.0"
