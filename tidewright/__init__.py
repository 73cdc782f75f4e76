"""Spark-native medallion analytics and training-data operators."""
