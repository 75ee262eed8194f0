"""Spark-native HTTP attack analytics and training-corpus operators."""
