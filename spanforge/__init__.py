"""A Spark-native engine for interval tables, binned signal tracks, reads and sequences."""
