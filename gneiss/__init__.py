"""gneiss package: Spark-first repository analytics."""
