"""Loads the query modules into the registry."""

from . import changes, drift, election, health, histories, ingest, states, views  # noqa: F401
from .registry import QUERIES, oracle_texts


def queries():
    return dict(QUERIES)


def oracles():
    return oracle_texts()
