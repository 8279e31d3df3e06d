"""Document privacy analytics on PySpark."""
