"""Registered queries: each runs library operators over the given tables, next to the
same result in plain SQL."""

from workload import documents, featured, files, games, modelled, relations, sequences, upkeep

MODULES = [sequences, relations, documents, games, featured, modelled, upkeep, files]
