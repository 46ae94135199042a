"""Repertoire analytics and large-corpus preparation as Spark DataFrame jobs."""
