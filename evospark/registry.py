"""All queries of the engine's own operators, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query; ``oracle`` is DuckDB SQL for its rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def load_all() -> None:
    """Imports the modules that register queries."""
    import importlib
    import pkgutil

    from . import plans

    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        importlib.import_module(f"{plans.__name__}.{module}")


load_all()
