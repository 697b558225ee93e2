"""winnow: resume screening analytics as Spark DataFrame operators."""
