"""Remote datasets and scores through injected clients, settings from files and environment.

A client is any object with ``pages()`` and ``page(number) -> list of dicts``; it is named by the path of
the function that makes it, so that every task makes its own. Nothing here knows a service.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

THREADS = 10


def made(path: str) -> Any:
    """What the function ``module:name`` returns."""
    module, name = path.split(":")
    return getattr(importlib.import_module(module), name)()


class PagesSource(DataSource):
    """Data source ``pages``: rows of a client's pages, one task a page. Options: client (module:function), schema (DDL)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options["client"], [f.name for f in schema.fields])


class _PagesReader(DataSourceReader):
    def __init__(self, client: str, names: list[str]) -> None:
        self.client, self.names = client, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(made(self.client).pages())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in made(self.client).page(partition.value):
            yield tuple(row.get(n) for n in self.names)


def remote_items(spark: SparkSession, client: str, schema: str) -> DataFrame:
    """Rows of a remote dataset."""
    spark.dataSource.register(PagesSource)
    return spark.read.format("pages").option("client", client).option("schema", schema).load()


def fetched_scores(traces: DataFrame, fetch: Callable[[str], list[tuple[str, Any]]]) -> DataFrame:
    """(trace, metric, value, pos, error) for each trace, ``THREADS`` calls at a time in a task; a failed call is a row with its error."""

    def one(trace: str) -> list[tuple]:
        try:
            return [(trace, name, None if value is None else str(value), i, None) for i, (name, value) in enumerate(fetch(trace))]
        except Exception as e:  # noqa: BLE001 - any failure of a service is data here
            return [(trace, None, None, None, str(e))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                rows = [r for part in pool.map(one, batch["trace"]) for r in part]
                yield pd.DataFrame(rows, columns=["trace", "metric", "value", "pos", "error"], dtype=object)

    return traces.select("trace").distinct().mapInPandas(run, "trace string, metric string, value string, pos int, error string")


def profiles(path: str) -> dict[str, dict]:
    """Settings by name from a JSON file, bare or under ``profiles``; no file, no profiles."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    return value.get("profiles", value)


def first_setting(env: Mapping[str, str], *names: str, required: bool = False) -> str | None:
    """The first of the variables that is set and not empty."""
    found = next((env[n] for n in names if env.get(n)), None)
    if found is None and required:
        raise KeyError(f"none of {', '.join(names)} is set")
    return found


class _Stub:
    """A client without a network: page n has n rows."""

    def pages(self) -> int:
        return 3

    def page(self, number: int) -> list[dict]:
        return [{"id": number * 10 + i, "name": f"n{i}"} for i in range(number)]


def stub() -> _Stub:
    return _Stub()
