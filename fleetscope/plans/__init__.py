"""Whole jobs assembled from the operators: insights, score, history, runs, reports."""
