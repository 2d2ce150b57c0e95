"""rowecho: how much of a table has leaked into text, measured with Spark jobs.

A dataset (any DataFrame) is profiled, its rows are written as text, probes with
known answers are built from them, responses are decided against the answers, and
the verdicts are aggregated into scorecards and reports. Every step is a function
from DataFrames to DataFrames.
"""
