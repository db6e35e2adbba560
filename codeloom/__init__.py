"""codeloom: Spark-native analytics over code-shaped data."""

__version__ = "0.1.0"
