"""Catalogue and price intelligence as Spark DataFrame transformations."""
