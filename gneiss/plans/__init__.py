"""gneiss plans: Spark-first repository analytics."""
