"""corpuscle: a Spark-native text-analytics engine."""
__version__ = "0.1.0"
