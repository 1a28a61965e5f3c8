"""Spark-native event-data engine: declarative plans over DataFrames."""
