"""Spark jobs over document corpora, code graphs and document histories."""
