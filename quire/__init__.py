"""Document analytics as Spark DataFrame plans."""
