"""Paperloom: document analytics and training-data operators as PySpark DataFrame jobs."""
