"""Registry of driver queries: name -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all():
    """Import every plan module so that its queries register."""
    from tessera.plans import corpus, readers, tagging, retrieval, concepts_q, qa, streams, selections  # noqa: F401
    return QUERIES, ORACLES
