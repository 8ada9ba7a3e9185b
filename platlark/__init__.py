"""Spark-first analytics for street names, recorded plats and place-name evidence."""
