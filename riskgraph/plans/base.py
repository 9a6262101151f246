"""How queries are registered: a function of ``Tables`` and the oracle's SQL over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from riskgraph.sources.adapter import SQL_VIEWS, Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
OWN: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``function(tables)``. ``sql`` sees the adapter's views; it may begin with CTEs of its own (``name AS (...), ... SELECT``)."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            own = OWN[name] = sql.strip()
            ORACLES[name] = f"WITH {SQL_VIEWS}{' ' if own.upper().startswith('SELECT') else ', '}{own}"
        return function

    return register


def nested(name: str, alias: str) -> str:
    """A registered query's SQL as a CTE of another's."""
    own = OWN[name]
    return f"{alias} AS ({'' if own.upper().startswith('SELECT') else 'WITH '}{own})"


def r4(e: str) -> str:
    """The oracle's ``expressions.r4``."""
    return f"(floor(({e}) * 1e4 + 0.5e0) / 1e4)"
