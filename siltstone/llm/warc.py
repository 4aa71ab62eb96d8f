"""WARC archives with an index: write records, index them, then read coalesced byte ranges.

Every task appends its rows to an archive of its own (one gzip member for each record, a new file once
``roll_bytes`` is reached) and emits an index row for each record: file, offset, length, URL, digest. File
names hold the task attempt, so what a lost attempt left is never referenced. Readers sort the index rows
they select by file and offset and read neighbouring records in one request.

A page learns its group's response by the digest of its payload. Groups of at least a thousandth of the repeated pages are at
most a thousand and broadcast; the others are joined, which moves every page once where they outgrow Spark's own broadcast.

Of records with equal payloads of at least ``revisit_from`` bytes, the one with the smallest page id is the
response; the others are revisits that hold the HTTP head (with the payload's length) and its digest.

Defined cases: null html is an empty payload; a null URL gives no target header; line breaks in a URL are
percent-encoded; rows repeated with the response's page_id are responses too; a null page_id never becomes the
response of a group that has another; empty tables give an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, join_sized, ship, written

INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> tuple[str, str, bytes]:
    """(type, digest, bytes) of one uncompressed record."""
    digest = base32_sha1(payload)
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return kind, digest, "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """One record: its headers in lower case, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields | {"block": rest[: int(fields["content-length"])]}


def _writer(out_dir: str, date: str, roll_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, name, at, files = None, "", 0, 0
        for pdf in batches:
            rows = []
            for page_id, url, html, first in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["first"]):
                page_id, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
                refers = first if first is not None and first != page_id else None
                kind, digest, raw = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers, date)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                if out is None or at + len(member) > roll_bytes:
                    if out is not None:
                        out.close()
                    name, at, files = f"{stem}-{files}.warc.gz", 0, files + 1
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                rows.append((name, at, len(member), url, digest, page_id, kind))
                at += len(member)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return write


def write_archives(
    pages: DataFrame,
    out_dir: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_from: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    roll_bytes: int = 1 << 28,
) -> DataFrame:
    """Write the archives below ``out_dir``; return their index, written to ``out_dir``/index."""
    spark = pages.sparkSession
    fs, root = pafs.FileSystem.from_uri(out_dir)
    fs.create_dir(root, recursive=True)
    rows = columns(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= revisit_from, F.sha2("html", 256)))
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = written(groups.where("n > 1 and digest is not null"), "responses")
    index = join_sized(rows, firsts, "digest", "n", ["page_id", "url"]).mapInPandas(_writer(out_dir, date, roll_bytes), INDEX)
    index.write.parquet(f"{out_dir}/index")
    return read_index(spark, out_dir)


def read_index(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{out_dir}/index")


def _reader(out_dir: str, gap: int, request: int):
    def rows_of(fs, path: str, ranges: list[tuple[int, int]]) -> Iterator[tuple]:
        start, end = ranges[0][0], ranges[-1][0] + ranges[-1][1]
        with fs.open_input_file(path) as f:
            f.seek(start)
            data = f.read(end - start)
        for offset, length in ranges:
            rec = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
            http, _, payload = rec["block"].partition(b"\r\n\r\n")
            size = int(http.rsplit(b"Content-Length: ", 1)[1])
            digest = rec["warc-payload-digest"].removeprefix("sha1:")
            if rec["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                raise ValueError(f"damaged record in {path} at {offset}")
            ids = [rec[k][len(URN) + 1 : -1] if k in rec else "" for k in ("warc-record-id", "warc-refers-to")]
            page, refers = (int(x) if x else None for x in ids)
            yield page, rec.get("warc-target-uri"), size, digest, rec["warc-type"], refers

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        names = [c.split()[0] for c in RECORD.split(", ")]

        def flush(name: str, ranges: list[tuple[int, int]]) -> pd.DataFrame:
            rows = list(rows_of(fs, f"{root}/{name}", ranges))
            return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

        current, ranges = None, []
        for pdf in batches:
            for name, offset, length in zip(pdf["file"], pdf["offset"], pdf["length"]):
                if ranges and (
                    name != current or offset - sum(ranges[-1]) > gap or offset + length - ranges[0][0] > request
                ):
                    yield flush(current, ranges)
                    ranges = []
                current = name
                ranges.append((int(offset), int(length)))
        if ranges:
            yield flush(current, ranges)

    return read


def read_records(index: DataFrame, out_dir: str, gap: int = 1 << 16, request: int = 1 << 22, split: int = 1 << 26) -> DataFrame:
    """The selected records of an index: requests join ranges at most ``gap`` bytes apart, up to ``request`` bytes.

    Every ``split`` bytes of an archive are a task of their own; their number is fixed here, as an index row is too small for
    Spark to tell how much its record weighs.
    """
    ranges = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / split))
    tasks = ranges.agg(F.count_distinct("file", "stretch")).first()[0]
    return (
        ranges.repartition(max(1, tasks), "file", "stretch")
        .sortWithinPartitions("file", "offset")
        .mapInPandas(_reader(out_dir, gap, request), RECORD)
    )


ship(__name__)
