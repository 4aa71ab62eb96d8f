"""Client archives: tar files in parts that several tasks write, with an index of where each member lies.

The parts of a client, joined in the order of their names, are one tar file: a head with the manifest, the members by path, and the end
mark. Tasks get ranges of (client, path), so a large client is written by many tasks and a small one shares a task with others. Each
part is written under a name of the task attempt and moved into place, so a repeated task does no harm.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

# What a key of a setting must hold to be a secret, what takes a secret's place, and the form of a manifest.
SECRET = ("token", "secret", "password", "credential")
HIDDEN = "[REDACTED]"
MANIFEST, MANIFEST_VERSION = "export_manifest.json", 1
MEMBERS = "client_id string, path string, part string, offset long, size long, sha256 string"
BLOCK = 512


def without_secrets(value):
    """A JSON value whose secrets are hidden at any depth; keys that end in _env name a variable and stay."""
    if isinstance(value, list):
        return [without_secrets(v) for v in value]
    if not isinstance(value, dict):
        return value
    secret = {k: any(w in k.lower() for w in SECRET) for k in value}
    return {k: without_secrets(v) if not secret[k] else v if k.lower().endswith("_env") else HIDDEN for k, v in value.items()}


def _hidden(paths: pd.Series, bodies: pd.Series) -> pd.Series:
    """Bodies of JSON files without secrets, keys sorted; others, and files that are no JSON, as they are."""
    out = []
    for path, body in zip(paths, bodies):
        body = b"" if body is None else bytes(body)
        if path is not None and path.lower().endswith(".json"):
            try:
                body = (json.dumps(without_secrets(json.loads(body)), indent=2, sort_keys=True) + "\n").encode()
            except ValueError:
                pass
        out.append(body)
    return pd.Series(out, dtype=object)


def redacted_body(path: Column, body: Column) -> Column:
    return F.pandas_udf(_hidden, "binary")(path, body)


def member_head(name: str, size: int) -> bytes:
    """The header blocks of a member; long and non-ASCII names take more than one."""
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.PAX_FORMAT, "utf-8", "surrogateescape")


def _padded(body: bytes) -> bytes:
    return body + b"\0" * (-len(body) % BLOCK)


def _put(fs, root: str, name: str, chunks: Iterator[bytes]) -> None:
    """Write a file below ``root`` under the attempt's name, then move it into place."""
    folder, _, last = name.rpartition("/")
    fs.create_dir(f"{root}/{folder}", recursive=True)
    context = TaskContext.get()
    attempt = f"{root}/{folder}/_{context.taskAttemptId()}-{last}"
    with fs.open_output_stream(attempt, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(attempt, f"{root}/{name}")


def _write(out_dir: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        task = TaskContext.get().partitionId()
        out, client, attempt, at = None, None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(attempt, f"{root}/{client}/part-1-{task:06d}.tar")

        for pdf in batches:
            rows = []
            for owner, path, body in zip(pdf["client_id"], pdf["path"], pdf["body"]):
                if out is None or owner != client:
                    close()
                    client, at = owner, 0
                    fs.create_dir(f"{root}/{client}", recursive=True)
                    attempt = f"{root}/{client}/_{TaskContext.get().taskAttemptId()}-{task:06d}"
                    out = fs.open_output_stream(attempt, compression=None)
                body = b"" if body is None else bytes(body)
                head = member_head(f"{client}/{path}", len(body))
                out.write(head)
                out.write(_padded(body))
                rows.append((client, path, f"part-1-{task:06d}.tar", at + len(head), len(body), sha256(body).hexdigest()))
                at += len(head) + len(_padded(body))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")])
        close()

    return run


def _close(out_dir: str, exported_at: str, redact: bool):
    """The head and the end of each client's archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for pdf in batches:
            rows = []
            for client, n, size in zip(pdf["client_id"], pdf["n_members"], pdf["bytes"]):
                manifest = {"artifact_schema_version": MANIFEST_VERSION, "exported_at": exported_at, "client_id": client, "redacted": redact, "members": int(n), "bytes": int(size)}
                body = (json.dumps(manifest, indent=2, sort_keys=True) + "\n").encode()
                head = member_head(f"{client}/{MANIFEST}", len(body))
                _put(fs, root, f"{client}/part-0.tar", iter([head, _padded(body)]))
                _put(fs, root, f"{client}/part-2.tar", iter([b"\0" * (2 * BLOCK)]))
                rows.append((client, len(head) + len(_padded(body))))
            yield pd.DataFrame(rows, columns=["client_id", "head"])

    return run


def export_clients(members: DataFrame, out_dir: str, exported_at: str, redact: bool = True) -> DataFrame:
    """Write an archive below ``out_dir`` for each client of ``members`` (client_id, path, body binary); returns the index of members.

    Per member: client_id, path, part, its bytes' offset in the part and in the whole archive (``start``), size and sha256. Null bodies are empty;
    rows without a client or a path are left out; clients' ids must be names of folders. The index is kept below ``out_dir`` too.
    """
    spark = members.sparkSession
    rows = members.where("client_id IS NOT NULL AND path IS NOT NULL").select("client_id", "path", F.col("body").cast("binary").alias("body"))
    dealt = rows.repartitionByRange("client_id", "path").sortWithinPartitions("client_id", "path")
    if redact:
        dealt = dealt.withColumn("body", redacted_body(F.col("path"), F.col("body")))
    dealt.mapInPandas(_write(out_dir), MEMBERS).write.parquet(f"{out_dir}/_members")
    index = spark.read.schema(MEMBERS).parquet(f"{out_dir}/_members")
    totals = index.groupBy("client_id").agg(F.count("*").alias("n_members"), F.sum("size").alias("bytes"))
    totals.mapInPandas(_close(out_dir, exported_at, redact), "client_id string, head long").write.parquet(f"{out_dir}/_heads")
    heads = spark.read.schema("client_id string, head long").parquet(f"{out_dir}/_heads")
    # a part ends with its last member's padding; the parts before it and the head say where it starts in the whole
    ends = index.groupBy("client_id", "part").agg(F.max(F.col("offset") + F.ceil(F.col("size") / BLOCK) * BLOCK).alias("length"))
    before = Window.partitionBy("client_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("before", F.coalesce(F.sum("length").over(before), F.lit(0))).join(heads, "client_id")
    starts = starts.select("client_id", "part", (F.col("before") + F.col("head")).alias("base"))
    return index.join(starts, ["client_id", "part"]).select(*index.columns, (F.col("base") + F.col("offset")).cast("long").alias("start"))


def _read(out_dir: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        file, name = None, None
        for pdf in batches:
            bodies = []
            for client, part, offset, size in zip(pdf["client_id"], pdf["part"], pdf["offset"], pdf["size"]):
                if name != (client, part):
                    if file is not None:
                        file.close()
                    file, name = fs.open_input_file(f"{root}/{client}/{part}"), (client, part)
                file.seek(offset)
                bodies.append(file.read(size))
            yield pd.DataFrame({"client_id": pdf["client_id"], "path": pdf["path"], "body": bodies})
        if file is not None:
            file.close()

    return run


def read_members(index: DataFrame, out_dir: str) -> DataFrame:
    """(client_id, path, body) of the members that ``index`` names, by ranges of its parts in order; no archive is read as a whole."""
    wanted = index.repartitionByRange("client_id", "part", "offset").sortWithinPartitions("client_id", "part", "offset")
    return wanted.mapInPandas(_read(out_dir), "client_id string, path string, body binary")


def whole_archive(out_dir: str, client_id: str) -> bytes:
    """A client's archive as one tar file in memory; for small ones."""
    fs, root = pafs.FileSystem.from_uri(out_dir)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{client_id}"))
    out = io.BytesIO()
    for info in sorted((f for f in found if f.base_name.startswith("part-")), key=lambda f: f.base_name):
        with fs.open_input_file(info.path) as f:
            out.write(f.read())
    return out.getvalue()


ship(__name__)
