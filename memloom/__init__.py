"""Spark-first retrieval, curation and graph analytics over tables of text facts."""
