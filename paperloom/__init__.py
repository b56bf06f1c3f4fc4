"""Paperloom: document question-answering data jobs as Spark DataFrame operators."""
