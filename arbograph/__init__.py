"""arbograph: a Spark-native engine for typed, attributed entity graphs."""
