"""A Spark-native engine that normalises and geocodes Japanese addresses."""
