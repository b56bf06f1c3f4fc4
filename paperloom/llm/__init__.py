"""Operators for building language-model training data, each one a set of Spark jobs."""
