"""gneiss streaming: Spark-first repository analytics."""
