"""gneiss sources: Spark-first repository analytics."""
