"""Column functions: everything here takes and returns ``pyspark.sql.Column``."""
