"""Registered queries over the sample tables, and the SQL each one is checked against."""
