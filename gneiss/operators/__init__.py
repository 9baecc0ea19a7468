"""gneiss operators: Spark-first repository analytics."""
