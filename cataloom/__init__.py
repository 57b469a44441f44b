"""Product-catalog intelligence as Spark DataFrame operators."""
