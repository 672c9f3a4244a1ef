"""Operators for preparing training text, each with its registered query."""

from lagwise.llm import workload

QUERIES = workload.QUERIES
ORACLE = workload.ORACLE
