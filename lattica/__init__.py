"""Metagenome linkage analytics as Spark DataFrame operators."""
