"""Spark-native evidence analytics over fact relations."""
