"""Spark jobs that turn a mixed corpus of files into a searchable, linked knowledge base."""
