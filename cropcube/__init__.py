"""cropcube: a Spark-native engine for multi-temporal earth-observation data."""
