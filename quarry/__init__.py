"""Quarry: a Spark-first engine for building, checking, searching and evaluating catalogs."""
