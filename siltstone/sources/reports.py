"""Daily reports of a system as a Spark data source: batch and stream, with partial reports marked.

A report is asked for by day, columns and a row limit, and tells how many rows there are in all. Each day is a partition, so days are read
in parallel and a lost executor's day is asked for again. Every row carries ``reported`` (the day's rows at the system) and ``partial`` (whether
the limit cut them), so what is summed from a partial report can be told from what is whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..shipping import ship

#: (day, columns, limit) -> (at most ``limit`` rows with these columns, number of rows of the day)
Fetch = Callable[[date, tuple[str, ...], int], tuple[list[tuple], int]]
LIMIT = 1000


@dataclass
class Day(InputPartition):
    day: date


def _days(first: date, last: date) -> list[Day]:
    return [Day(first + timedelta(i)) for i in range((last - first).days + 1)]


class _Reports:
    """What batch and stream readers share: the columns asked for and the rows of a day."""

    def __init__(self, fetch: Fetch, columns: tuple[str, ...], limit: int) -> None:
        self.fetch, self.columns, self.limit = fetch, columns, limit

    def read(self, partition: Day):
        rows, reported = self.fetch(partition.day, self.columns, self.limit)
        for row in rows[: self.limit]:
            yield (partition.day, *row, reported, reported > self.limit)


class ReportReader(_Reports, DataSourceReader):
    def __init__(self, fetch: Fetch, columns: tuple[str, ...], limit: int, first: date, last: date) -> None:
        super().__init__(fetch, columns, limit)
        self.first, self.last = first, last

    def partitions(self) -> list[Day]:
        return _days(self.first, self.last)


class ReportStream(_Reports, DataSourceStreamReader):
    """Whole days in order: an offset is the last day that has been read."""

    def __init__(self, fetch: Fetch, columns: tuple[str, ...], limit: int, first: date, latest: Callable[[], date]) -> None:
        super().__init__(fetch, columns, limit)
        self.first, self.latest = first, latest

    def initialOffset(self) -> dict:
        return {"through": (self.first - timedelta(1)).isoformat()}

    def latestOffset(self) -> dict:
        return {"through": max(self.latest(), self.first - timedelta(1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return _days(date.fromisoformat(start["through"]) + timedelta(1), date.fromisoformat(end["through"]))

    def commit(self, end: dict) -> None:
        """Nothing is kept at the system; the checkpoint holds the offset."""


def report_source(label: str, fetch: Fetch, types: dict[str, str], latest: Callable[[], date] | None = None) -> type[DataSource]:
    """A data source named ``label`` over ``fetch``; ``types`` are the report's columns.

    Options: ``start_date``, ``end_date`` (batch), ``limit`` and ``columns`` (comma-separated, by default all): only these are asked for.
    ``latest`` tells the last day that is complete; a stream needs it.
    """

    class Reports(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def _columns(self) -> tuple[str, ...]:
            named = self.options.get("columns")
            return tuple(c.strip() for c in named.split(",")) if named else tuple(types)

        def schema(self) -> str:
            return ", ".join(["day date", *(f"`{c}` {types[c]}" for c in self._columns()), "reported long", "partial boolean"])

        def _limit(self) -> int:
            return int(self.options.get("limit", LIMIT))

        def reader(self, schema) -> DataSourceReader:
            first, last = (date.fromisoformat(self.options[k]) for k in ("start_date", "end_date"))
            return ReportReader(fetch, self._columns(), self._limit(), first, last)

        def streamReader(self, schema) -> DataSourceStreamReader:
            if latest is None:
                raise ValueError(f"{label} doesn't say which day is its last")
            return ReportStream(fetch, self._columns(), self._limit(), date.fromisoformat(self.options["start_date"]), latest)

    return Reports


def read_reports(spark: SparkSession, source: type[DataSource], columns: list[str], start_date: str, end_date: str, limit: int = LIMIT) -> DataFrame:
    """Reports of a window of days. Days and columns reach the system as options: Spark 4.1 keeps filters that a Python source has taken
    for later queries over the same DataFrame, which would then lack rows.
    """
    spark.dataSource.register(source)
    options = {"columns": ",".join(columns), "start_date": start_date, "end_date": end_date, "limit": str(limit)}
    return spark.read.format(source.name()).options(**options).load()


def stream_reports(spark: SparkSession, source: type[DataSource], columns: list[str], start_date: str, limit: int = LIMIT) -> DataFrame:
    """The same as a stream of whole days from ``start_date`` on."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(columns=",".join(columns), start_date=start_date, limit=str(limit)).load()


def completeness(reports: DataFrame, by: list[str], measures: list) -> DataFrame:
    """Measures by ``by``, with the days they come from and the flag ``partial_data`` where any of these was cut."""
    days = reports.groupBy(*by, "day").agg(F.max("reported").alias("_reported"), F.count("*").alias("_rows"), F.max("partial").alias("_partial"))
    flags = days.groupBy(*by).agg(
        F.count("*").alias("n_days"), F.sum("_rows").alias("n_rows"), F.sum("_reported").alias("n_reported"), F.max("_partial").alias("partial_data")
    )
    sums = reports.groupBy(*by).agg(*measures) if by else reports.agg(*measures)
    return sums.join(flags, by) if by else sums.crossJoin(F.broadcast(flags))  # one row each


ship(__name__)
