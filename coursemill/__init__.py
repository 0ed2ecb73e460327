"""Course-knowledge analytics written as Spark DataFrame jobs."""
