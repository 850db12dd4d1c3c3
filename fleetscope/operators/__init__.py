"""Relational building blocks: skew-safe joins, medians and ranks, timelines, diffs, rules."""
