"""Bi-temporal memory and knowledge analytics as Spark DataFrame transforms."""
