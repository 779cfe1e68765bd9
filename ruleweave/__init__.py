"""Associative classification of small-domain records as Spark jobs."""
