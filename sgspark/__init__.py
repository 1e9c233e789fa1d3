"""A Spark-native engine for statistical-genetics estimators."""
