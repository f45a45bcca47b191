"""Spark jobs that analyse source-code and text corpora."""
