"""Code, document and evidence analytics as PySpark DataFrame jobs."""
