"""Spark-native evidence and capability analytics: DataFrame in, DataFrame out."""
