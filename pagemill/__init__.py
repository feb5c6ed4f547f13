"""A Spark-native engine for page-description programs and the tables they produce."""
