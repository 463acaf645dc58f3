"""graphloam: a Spark-native analytics engine for annotated knowledge graphs."""

__version__ = "0.1.0"
