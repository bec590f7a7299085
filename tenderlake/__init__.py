"""Public-procurement tender analytics as PySpark DataFrame jobs."""
