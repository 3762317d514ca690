"""Column expressions: every function returns a ``pyspark.sql.Column``."""
