"""Correspondence and document-operations analytics as Spark jobs."""
