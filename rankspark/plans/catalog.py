"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from rankspark.session import tune

MODULES = ("ranking", "features", "studies", "checks", "training", "tails", "files")

Query = Callable[[SparkSession, str], DataFrame]


def _tuned(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)
    return run


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out.update({k: _tuned(f) for k, f in import_module(f"rankspark.plans.{name}").QUERIES.items()})
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"rankspark.plans.{name}").SQL)
    return out
