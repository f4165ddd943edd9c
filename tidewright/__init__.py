"""Spark-native strategy evaluation over ordered price series."""
