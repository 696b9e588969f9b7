"""Named queries with the operators they cover and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    name: str
    ids: tuple[str, ...]
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(run: Run) -> Run:
        name = run.__name__
        if name in REGISTRY:
            raise ValueError(f"two queries are called {name}")
        REGISTRY[name] = Query(name, tuple(ids.split()), run, sql)
        return run

    return add
