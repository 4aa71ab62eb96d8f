"""Tables in buckets of files that are replaced a bucket at a time, and become visible by one commit file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Of files of which a task has several open at a time.
ROW_GROUP_BYTES = 1 << 24


class Conflict(RuntimeError):
    """Another writer has committed since this one read the tables."""


class Store:
    """Tables below one folder whose rows are dealt to ``buckets`` by the hash of a key.

    A write makes new files for the buckets it touches and leaves the others where they are. A commit file names, for each
    table, the files of every bucket; it is created under the next number and never overwritten, so readers see a whole write or
    nothing of it, and of two writers the second fails. A commit file that isn't whole yet is passed over; if its writer was lost, it has to be
    deleted before the next write. The driver holds one short text for each bucket and table.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if (last := self.last_commit())["number"]:
            self.buckets = last["buckets"]

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def last_commit(self) -> dict:
        """The newest commit: its number, the number of buckets and, for each table, its schema and the version of each bucket."""
        for name in reversed([n for n in self._names(f"{self.root}/commits") if n.endswith(".json")]):
            stream = self._fs.open(self._path(f"{self.root}/commits/{name}"))
            try:
                return json.loads(bytes(stream.readAllBytes()))
            except ValueError:  # still being written
                continue
            finally:
                stream.close()
        return {"number": 0, "buckets": self.buckets, "tables": {}}

    def read(self, table: str, commit: dict | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as of a commit, by default the newest, with its ``bucket``; None before its first write."""
        found = (commit or self.last_commit())["tables"].get(table)
        if found is None:
            return None
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/{table}/stored_version={v}/bucket={b}" for b, v in found["versions"].items() if wanted is None or int(b) in wanted]
        schema = StructType.fromJson(found["schema"])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*schema.fieldNames())

    def deal(self, rows: DataFrame, key: Column, pieces: int) -> DataFrame:
        """Rows with their ``piece``: each bucket's rows go to ``pieces`` tasks by their key, so that a large bucket needs no large task.

        Pieces are numbered through all buckets and a task gets the one of its number, where a hash would give it several by chance.
        """
        piece = F.pmod(F.xxhash64(key.cast("string"), F.lit("piece")), F.lit(pieces)).cast("int")
        return rows.withColumn("piece", F.col("bucket") * pieces + piece).repartitionById(self.buckets * pieces, "piece")

    @contextmanager
    def _file_of_each_bucket(self) -> Iterator[None]:
        """A task that writes keeps a file open for each bucket, where Spark would sort all its rows by bucket first."""
        key = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, self.buckets)
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def stage(self, table: str, version: str, rows: DataFrame, sort: list[str], dealt: bool = False) -> DataFrame:
        """Write the rows of touched buckets under a version that no commit names yet, and read them back; ``dealt`` rows stay in their tasks.

        Without ``sort`` rows are written as they come and none are held. A task then has files of several buckets open, so row groups are small.
        """
        rows = rows if dealt else rows.repartition("bucket")
        write = lambda rows: rows.write.partitionBy("bucket").option("compression", "zstd")
        to = f"{self.root}/{table}/stored_version={version}"
        if sort:
            write(rows.sortWithinPartitions("bucket", *sort)).parquet(to)
        else:
            with self._file_of_each_bucket():
                write(rows).option("parquet.block.size", ROW_GROUP_BYTES).parquet(to)
        held = {c: rows.schema[c] for c in rows.columns}
        schema = StructType([*(f for c, f in held.items() if c != "bucket"), held["bucket"]])
        self._staged[table] = schema
        if not any(n.startswith("bucket=") for n in self._names(to)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(to)

    def begin(self) -> tuple[dict, str]:
        """(the commit to build on, a fresh version)."""
        last = self.last_commit()
        self._staged: dict[str, StructType] = {}
        return last, f"{last['number'] + 1:012d}-{uuid.uuid4().hex[:8]}"

    def commit(self, last: dict, version: str, touched: list[int]) -> int:
        """Make what was staged under ``version`` the content of the touched buckets, on top of ``last``; returns the commit's number."""
        tables = dict(last["tables"])
        for table, schema in self._staged.items():
            kept = {b: v for b, v in tables.get(table, {"versions": {}})["versions"].items() if int(b) not in set(touched)}
            made = [n.removeprefix("bucket=") for n in self._names(f"{self.root}/{table}/stored_version={version}") if n.startswith("bucket=")]
            tables[table] = {"schema": json.loads(schema.json()), "versions": kept | dict.fromkeys(made, version)}
        number = last["number"] + 1
        body = json.dumps({"number": number, "buckets": self.buckets, "tables": tables})
        path = self._path(f"{self.root}/commits/{number:012d}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            raise Conflict(f"commit {number} is there already") from e
        stream.write(body.encode())
        stream.close()
        return number

    def forget_old(self) -> int:
        """Delete files that the newest commit doesn't name; returns the number of folders. No reader may use an older commit."""
        tables, gone = self.last_commit()["tables"], 0
        for table, found in tables.items():
            live = {f"stored_version={v}/bucket={b}" for b, v in found["versions"].items()}
            for version in self._names(f"{self.root}/{table}"):
                for bucket in self._names(f"{self.root}/{table}/{version}"):
                    if bucket.startswith("bucket=") and f"{version}/{bucket}" not in live:
                        self._fs.delete(self._path(f"{self.root}/{table}/{version}/{bucket}"), True)
                        gone += 1
        return gone
