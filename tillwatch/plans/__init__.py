"""Whole runs put together from the operators, and the queries over their results."""
