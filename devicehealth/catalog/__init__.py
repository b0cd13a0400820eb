"""Registered queries."""

from importlib import import_module

MODULES = (
    "sources cleaning filters joins aggregates windows labels alerts models evaluation clustering "
    "explanation forecasting streams"
).split()


def load():
    """Import every query module; return the queries and their SQL by name."""
    for module in MODULES:
        import_module(f"devicehealth.catalog.{module}")
    from devicehealth.catalog.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
