"""Spark-native learning and scoring of tree-shaped distributions over categorical data."""
