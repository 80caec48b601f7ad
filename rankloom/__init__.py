"""Spark-native analytics engine for ranking pools of candidates."""
