"""Spark jobs that turn captions and transcripts into a searchable vector table."""
