"""Skyloom: imaging-opportunity analytics and corpus preparation as Spark jobs."""
