"""Point-in-time sports and market analytics as PySpark DataFrame jobs."""
