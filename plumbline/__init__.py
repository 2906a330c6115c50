"""Spark-native annotation-dataset quality engine: DataFrame in, DataFrame out."""
