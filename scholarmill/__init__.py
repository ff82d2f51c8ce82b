"""Spark-native analytics over bibliographic records, full texts and vectors."""
