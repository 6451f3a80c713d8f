"""Spark-native analytics for agent trajectories, retrieval corpora and mail archives."""
