"""Quern: a Spark-native engine for document stores, retrieval and their evaluation."""
