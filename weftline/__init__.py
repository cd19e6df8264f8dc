"""Change-set analytics as Spark DataFrame operators."""
