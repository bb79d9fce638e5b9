"""All registered queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("evaluation", "corpus", "finance", "advice", "store", "streams", "sources")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").ORACLES
    return out
