"""Queries over the driver's tables: each operator with the SQL it is checked against."""
