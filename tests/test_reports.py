"""Daily reports: partial flags, days and columns that are asked for, and streams that go on where they stopped."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from siltstone.sources import reports

TYPES = {"page": "string", "visits": "long"}


def system(folder):
    """A system that keeps a file for each day and notes each request."""

    def fetch(day, columns, limit):
        with open(f"{folder}/asked", "a") as log:
            log.write(json.dumps([day.isoformat(), list(columns), limit]) + "\n")
        path = f"{folder}/{day.isoformat()}.json"
        rows = json.load(open(path)) if os.path.exists(path) else []
        return [tuple(r[c] for c in columns) for r in rows[:limit]], len(rows)

    def latest():
        return date.fromisoformat(max(f[:10] for f in os.listdir(folder) if f.endswith(".json")))

    return fetch, latest


def write_day(folder, day, n):
    (folder / f"{day}.json").write_text(json.dumps([{"page": f"{day}/{i}", "visits": i} for i in range(n)]))


def asked(folder):
    lines = [json.loads(x) for x in (folder / "asked").read_text().splitlines()] if (folder / "asked").exists() else []
    (folder / "asked").unlink(missing_ok=True)
    return lines


def test_days_and_columns_are_asked_for_and_partial_days_marked(spark, tmp_path):
    fetch, _ = system(str(tmp_path))
    for day, n in (("2024-01-01", 3), ("2024-01-02", 12), ("2024-01-03", 0), ("2024-01-04", 5)):
        write_day(tmp_path, day, n)
    source = reports.report_source("test_days", fetch, TYPES)
    df = reports.read_reports(spark, source, ["visits"], "2024-01-02", "2024-01-04", limit=10)
    assert df.columns == ["day", "visits", "reported", "partial"]
    got = df.where("visits > 1").collect()
    seen = asked(tmp_path)
    assert sorted({a[0] for a in seen}) == ["2024-01-02", "2024-01-03", "2024-01-04"] and {tuple(a[1]) for a in seen} == {("visits",)}
    assert {(r.day.isoformat(), r.visits) for r in got} == {("2024-01-02", i) for i in range(2, 10)} | {("2024-01-04", i) for i in range(2, 5)}
    assert {(r.day.day, r.reported, r.partial) for r in got} == {(2, 12, True), (4, 5, False)}
    assert df.where("day = DATE'2024-01-04'").count() == 5 and df.count() == 15  # a filter of one query leaves the next alone
    df = reports.read_reports(spark, source, ["visits"], "2024-01-01", "2024-01-31", limit=10)
    whole = reports.completeness(df, [], [F.sum("visits").alias("visits")]).first()
    assert (whole.visits, whole.n_days, whole.n_rows, whole.n_reported, whole.partial_data) == (3 + 45 + 10, 3, 18, 20, True)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    days, out, state = tmp_path / "days", tmp_path / "out", tmp_path / "state"
    days.mkdir()
    fetch, latest = system(str(days))
    source = reports.report_source("test_stream", fetch, TYPES, latest)

    def run():
        df = reports.stream_reports(spark, source, ["page", "visits"], "2024-01-01", limit=100)
        df.writeStream.format("parquet").option("checkpointLocation", f"file://{state}").trigger(availableNow=True).start(f"file://{out}").awaitTermination(120)

    write_day(days, "2024-01-01", 4)
    write_day(days, "2024-01-02", 2)
    run()
    assert spark.read.parquet(f"file://{out}").count() == 6
    asked(days)
    run()  # nothing new
    assert spark.read.parquet(f"file://{out}").count() == 6 and asked(days) == []
    write_day(days, "2024-01-03", 5)
    write_day(days, "2024-01-05", 1)
    run()
    rows = [r.page for r in spark.read.parquet(f"file://{out}").collect()]
    assert sorted(rows) == sorted([f"2024-01-01/{i}" for i in range(4)] + [f"2024-01-02/{i}" for i in range(2)] + [f"2024-01-03/{i}" for i in range(5)] + ["2024-01-05/0"])
    assert {a[0] for a in asked(days)} == {"2024-01-03", "2024-01-04", "2024-01-05"}


def test_a_stream_needs_to_know_the_last_day(spark):
    source = reports.report_source("test_no_last", lambda day, columns, limit: ([], 0), TYPES)
    with pytest.raises(Exception, match="last"):
        df = reports.stream_reports(spark, source, ["page"], "2024-01-01")
        df.writeStream.format("noop").trigger(availableNow=True).start().awaitTermination(60)
