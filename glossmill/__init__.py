"""Spark-native corpus augmentation, evaluation-set construction and scoring."""
