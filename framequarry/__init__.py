"""Framequarry: compressed byte frames as data, on Spark."""
