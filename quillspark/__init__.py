"""quillspark: a Spark-native text analytics engine (DataFrame and SQL first)."""

__version__ = "0.1.0"
