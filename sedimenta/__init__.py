"""A Spark-native analytics engine for code and text corpora."""
