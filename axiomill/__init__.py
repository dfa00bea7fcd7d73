"""axiomill: a PySpark-native analytics engine for knowledge bases."""

__version__ = "0.1.0"
