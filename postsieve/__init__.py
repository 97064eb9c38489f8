"""Posting intelligence on Spark: normalize, deduplicate, extract, score, query."""
