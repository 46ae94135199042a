"""Registered queries: operators applied to the driver's tables, with their DuckDB SQL."""

from tessera.plans import queries, reports  # noqa: F401  reports adds to the registry of queries
