"""Spark-native survival and causal-inference analytics."""
