"""Early-warning analytics for learning-platform exports, as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
