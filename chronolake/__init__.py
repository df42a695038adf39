"""chronolake: a PySpark-native analytics engine for tagged time-series points."""

__version__ = "0.1.0"
