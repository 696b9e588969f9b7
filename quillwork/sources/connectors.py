"""Pluggable connectors: a registry of fetchers behind one data source, with a fixture-backed stub.

Network access is the caller's business: a fetcher yields a source's pages.  The stub reads them from JSON lines, which
is how tests and offline runs work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FETCHERS: dict[str, Callable[[dict], Iterator[tuple[str, str]]]] = {}


def fetcher(kind: str) -> Callable:
    """Registers a fetcher: options -> (key, body) pages."""

    def add(f: Callable) -> Callable:
        FETCHERS[kind] = f
        return f

    return add


@fetcher("fixture")
def fixture(options: dict) -> Iterator[tuple[str, str]]:
    """Pages given inline as a JSON array of {"key", "body"}."""
    for page in json.loads(options.get("pages", "[]")):
        yield page["key"], page["body"]


@fetcher("echo")
def echo(options: dict) -> Iterator[tuple[str, str]]:
    """One page that holds the text it was asked with."""
    yield "0", options.get("text", "")


@fetcher("count")
def count(options: dict) -> Iterator[tuple[str, str]]:
    """As many numbered pages as it was asked for."""
    for i in range(int(options.get("text") or 0)):
        yield str(i), str(i)


def dispatched(catalogue: DataFrame, source: str, kind: str, options: str) -> DataFrame:
    """The pages of all sources of a catalogue, each read by the fetcher that its row names: source, kind, key, body.

    Sources run side by side on the executors; one whose kind nobody fetches, or whose fetcher fails, gives no pages.
    """
    names = catalogue.schema[source].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple] = []
            for s, k, text in zip(rows["s"], rows["k"], rows["o"], strict=True):
                try:
                    out += [(s, k, key, body) for key, body in FETCHERS[k]({"text": text})]
                except Exception:  # a source's failure must not stop the others
                    continue
            yield pd.DataFrame(out, columns=["s", "kind", "key", "body"])

    plain = catalogue.select(F.col(source).alias("s"), F.col(kind).alias("k"), F.col(options).alias("o"))
    return plain.mapInPandas(run, f"s {names}, kind string, key string, body string").withColumnRenamed("s", source)


class Paged(DataSource):
    """format("paged"): option `kind` names the fetcher, `most` ends after so many kept pages, `keep` is a pattern that
    a page's body must hold to be kept (N4)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "key string, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options), FETCHERS[self.options.get("kind", "fixture")])


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        most, keep, n = int(self.options.get("most", 0)), re.compile(self.options.get("keep", "")), 0
        for page in self.fetch(self.options):
            if keep.search(page[1]):
                yield page
                n += 1
                if n == most:
                    return


def pages(spark: SparkSession, kind: str = "fixture", **options: str) -> DataFrame:
    spark.dataSource.register(Paged)
    return spark.read.format("paged").options(kind=kind, **options).load()
