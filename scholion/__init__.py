"""Spark-native document retrieval, study analytics and corpus preparation."""
