"""A Spark-native engine for building and guarding text corpora."""
