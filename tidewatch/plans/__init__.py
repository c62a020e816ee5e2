"""Whole runs and the registered queries, each with the SQL it is checked against."""
