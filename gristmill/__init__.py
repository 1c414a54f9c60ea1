"""Gristmill: a Spark-native engine that audits and cleans tables."""
