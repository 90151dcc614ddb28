"""Spark-native document retrieval analytics: DataFrame in, DataFrame out."""
