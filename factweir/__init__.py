"""Evidence verification, run-history and traffic analytics as Spark DataFrame operators."""
