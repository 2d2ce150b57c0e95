"""Prompt texts, probe builders, complete runs and reports."""
