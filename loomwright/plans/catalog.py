"""Registry of queries and of their DuckDB equivalents."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function; a second use of a name raises KeyError."""

    def add(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    from loomwright.plans import dialog, evaluation, samples, sourcing, streams, text  # noqa: F401


_load()
