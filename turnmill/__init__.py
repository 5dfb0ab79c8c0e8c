"""Spark jobs that mine session transcripts."""
