"""Retail campaign analytics as Spark DataFrame operators."""
