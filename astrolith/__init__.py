"""astrolith: a PySpark-native analytics engine for source-code facts."""

__version__ = "0.1.0"
