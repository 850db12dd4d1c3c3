"""Queries by kind; each derives its digest columns from the real output of its operator."""
