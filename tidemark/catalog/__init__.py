"""Registered queries: each operator applied to the given tables, with its SQL twin."""

from tidemark.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> None:
    from tidemark.catalog import bars, chain, conformance, features, files, metrics, models, profiles, records  # noqa: F401
