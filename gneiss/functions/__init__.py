"""gneiss functions: Spark-first repository analytics."""
