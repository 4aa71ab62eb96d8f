"""Connectors of operational systems: each gives wide metrics for each client from tables it may read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.dates import in_window
from ..operators import evidence as V
from ..shipping import ship

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}")


class Connector(Protocol):
    """A system that can be read: ``metrics`` returns client_id and one column for each metric."""

    kind: str

    def metrics(self, parameters: dict[str, str]) -> DataFrame: ...


def _day(df: DataFrame, column: str, parameters: dict[str, str]) -> DataFrame:
    """Rows of the parameters' window; the filter reaches the scan."""
    if not parameters.get("start_date"):
        return df
    return df.where(in_window(F.to_date(column), parameters["start_date"], parameters["end_date"]))


@dataclass
class CrmTables:
    """Contacts (client_id, stage) and deals (client_id, amount, stage, created_at, closed_at)."""

    contacts: DataFrame
    deals: DataFrame
    kind: str = "crm"

    def metrics(self, parameters: dict[str, str]) -> DataFrame:
        return V.crm_metrics(self.contacts, _day(self.deals, "created_at", parameters), _day(self.deals, "closed_at", parameters), "client_id")


@dataclass
class AdsTable:
    """Campaign rows: client_id, day, cost_micros, impressions, clicks, conversions, conversions_value."""

    rows: DataFrame
    kind: str = "ads"

    def metrics(self, parameters: dict[str, str]) -> DataFrame:
        return V.ads_metrics(_day(self.rows, "day", parameters), ["client_id"])


@dataclass
class AnalyticsTable:
    """Report rows: client_id, day, sessions, key_events, engagement_rate."""

    rows: DataFrame
    kind: str = "analytics"

    def metrics(self, parameters: dict[str, str]) -> DataFrame:
        return V.analytics_metrics(_day(self.rows, "day", parameters), ["client_id"]).withColumn("conversions", F.col("key_events"))


@dataclass
class MockSystem:
    """Numbers that follow from the client's name, for tests and demonstrations."""

    spark: SparkSession
    clients: list[str]
    kind: str = "crm"

    def metrics(self, parameters: dict[str, str]) -> DataFrame:
        rows = [(c, 40 + 8 * len(c), 4 + len(c) % 7, 1000.0 * len(c)) for c in self.clients]
        return self.spark.createDataFrame(rows, "client_id string, leads long, opportunities long, pipeline_amount double")


class BudgetExceeded(RuntimeError):
    pass


def estimated_bytes(df: DataFrame) -> int:
    """Bytes that the optimised plan expects to read, by Spark's statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass
class Warehouse:
    """A table behind an allow-list and a byte budget; both are checked before anything runs."""

    spark: SparkSession
    allowed: tuple[str, ...]
    max_bytes: int = 1_000_000_000
    kind: str = "warehouse"

    def read(self, table: str) -> DataFrame:
        if not IDENTIFIER.fullmatch(table):
            raise ValueError(f"not a table name: {table!r}")
        if table not in self.allowed:
            raise PermissionError(f"table is not allowed: {table}")
        return self.spark.table(table)

    def checked(self, df: DataFrame) -> DataFrame:
        size = estimated_bytes(df)
        if size > self.max_bytes:
            raise BudgetExceeded(f"the query would read about {size} bytes; the budget is {self.max_bytes}")
        return df

    def rollup(self, table: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        source = self.read(table)
        self.checked(source)
        return build(source)


@dataclass
class Fetched:
    """Rows of a paged interface; ``truncated`` tells that the page budget ended the reading."""

    rows: DataFrame
    pages: int
    truncated: bool


def read_cursor(spark: SparkSession, fetch: Callable[[str | None, int], tuple[list[tuple], str | None]], schema: str, page_size: int = 200, max_pages: int = 50) -> Fetched:
    """Pages that name the next one by a cursor, read one after the other: at most ``page_size`` times ``max_pages`` rows.

    ``fetch`` takes a cursor (None first) and a page size and returns rows and the next cursor. Pages known by number are read
    in parallel by ``PagedSource``.
    """
    rows: list[tuple] = []
    cursor, pages = None, 0
    while pages < max_pages:
        page, cursor = fetch(cursor, page_size)
        rows, pages = rows + page[:page_size], pages + 1
        if cursor is None:
            break
    return Fetched(spark.createDataFrame(rows, schema), pages, cursor is not None)


def available() -> dict[str, type]:
    """Connectors by name."""
    return {"tables": CrmTables, "ads": AdsTable, "analytics": AnalyticsTable, "warehouse": Warehouse, "mock": MockSystem}


def discover(spark: SparkSession, allowed: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(table, column, type) of the allowed tables that exist, from the catalogue alone."""
    return [(name, c.name, c.dataType) for name in sorted(allowed) if spark.catalog.tableExists(name) for c in spark.catalog.listColumns(name)]


def setup_checks(connector: Connector, clients: list[str], live: bool = False) -> list[tuple[str, bool, str]]:
    """(check, ok, detail) of a connector: its kind and tables by their schemas; with ``live`` also that it returns rows for clients."""
    out = [("kind", bool(connector.kind), connector.kind)]
    for name, value in vars(connector).items():
        if isinstance(value, DataFrame):
            out.append((f"{name}.client_id", "client_id" in value.columns, ", ".join(value.columns)))
    if live:
        try:
            n = connector.metrics({}).where(F.col("client_id").isin(clients)).count()
            out.append(("live", n > 0, f"{n} clients"))
        except Exception as e:  # a check reports what a run would raise
            out.append(("live", False, f"{type(e).__name__}: {e}"[:200]))
    return out


class PagedSource(DataSource):
    """A paged interface as a batch source: one partition for each page, read in parallel on the executors.

    Options: ``pages`` (number of pages), ``page_size``, and the registered name of a fetcher in FETCHERS, a
    function (page, page_size) -> rows. A page that a lost executor held is fetched again.
    """

    @classmethod
    def name(cls) -> str:
        return "siltstone_paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


@dataclass
class Page(InputPartition):
    number: int


class PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.pages, self.size, self.fetcher = int(options["pages"]), int(options.get("page_size", 200)), options["fetcher"]

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(self.pages)]

    def read(self, partition: Page):
        module, _, name = self.fetcher.rpartition(":")
        import importlib

        fetch = getattr(importlib.import_module(module), name)
        yield from fetch(partition.number, self.size)


def numbered_rows(page: int, size: int):
    """A fetcher for tests: rows with their position."""
    for i in range(size):
        yield (page * size + i, f"row {page * size + i}")


ship(__name__)
