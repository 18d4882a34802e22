"""Queries over the reference tables, by name, and their SQL for a second engine."""
