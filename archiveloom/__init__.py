"""archiveloom: a PySpark-native engine for preparing and evaluating retrieval corpora."""

__version__ = "0.1.0"
