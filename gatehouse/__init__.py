"""Spark-native evaluation, routing and policy-selection engine."""
