"""Operators on datasets, probes and verdicts."""
