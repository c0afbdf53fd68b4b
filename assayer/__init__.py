"""Assessment-data analytics as Spark DataFrame transformations."""
