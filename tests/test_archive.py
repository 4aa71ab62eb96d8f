"""Client archives, read back by the standard library and by ranges."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from siltstone.sources import archive


def test_secrets_are_hidden_at_any_depth():
    value = {"api_Token": "x", "nested": [{"password": {"a": 1}, "SECRET_ENV": "NAME", "plain": None}], "credential_env": "Y", "n": 3}
    assert archive.without_secrets(value) == {"api_Token": "[REDACTED]", "nested": [{"password": "[REDACTED]", "SECRET_ENV": "NAME", "plain": None}], "credential_env": "Y", "n": 3}


@pytest.fixture(scope="module")
def members(spark):
    rows = [("big", f"notes/{i:04d}.txt", (f"text {i} é " * (i % 40)).encode()) for i in range(400)]
    rows += [("small", "a.txt", b""), ("small", "b.json", b'{"z": 1, "my_token": "t", "token_env": "V"}'), ("small", "c.JSON", b"no json {"), ("small", "d/" + "long" * 60 + ".txt", b"x" * 512)]
    rows += [("small", "ünï.txt", b"u"), ("small", "e.txt", None), (None, "x", b"x"), ("small", None, b"x")]
    return spark.createDataFrame(rows, "client_id string, path string, body binary")


def test_archives_are_read_back(spark, members, tmp_path):
    out = f"file://{tmp_path}/archives"
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one task's
    try:
        index = archive.export_clients(members, out, "2024-02-10T00:00:00+00:00").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {(r.client_id, r.path): bytes(r.body or b"") for r in members.collect() if r.client_id and r.path}
    want["small", "b.json"] = b'{\n  "my_token": "[REDACTED]",\n  "token_env": "V",\n  "z": 1\n}\n'
    assert {(r.client_id, r.path) for r in index} == set(want)
    assert len({r.part for r in index if r.client_id == "big"}) > 1
    for client in ("big", "small"):
        whole = archive.whole_archive(out, client)
        with tarfile.open(fileobj=io.BytesIO(whole)) as tar:
            names = tar.getnames()
            found = {n: tar.extractfile(n).read() for n in names}
        manifest = json.loads(found.pop(f"{client}/export_manifest.json"))
        assert names[0] == f"{client}/export_manifest.json" and manifest["redacted"] and manifest["members"] == len(found)
        assert found == {f"{c}/{p}": b for (c, p), b in want.items() if c == client}
        assert names[1:] == sorted(names[1:], key=lambda n: n.encode())
        for r in index:
            if r.client_id == client:
                assert whole[r.start : r.start + r.size] == want[client, r.path]
    some = spark.createDataFrame([r for r in index if r.path < "notes/0100"], archive.MEMBERS + ", start long")
    assert {(r.client_id, r.path): bytes(r.body) for r in archive.read_members(some, out).collect()} == {k: b for k, b in want.items() if k[1] < "notes/0100"}


def test_no_members_make_no_archive(spark, members, tmp_path):
    out = f"file://{tmp_path}/archives"
    assert archive.export_clients(members.where("false"), out, "now").count() == 0


def test_bodies_stay_without_redaction(spark, members, tmp_path):
    out = f"file://{tmp_path}/archives"
    index = archive.export_clients(members.where("path = 'b.json'"), out, "now", redact=False)
    assert bytes(archive.read_members(index, out).first().body) == b'{"z": 1, "my_token": "t", "token_env": "V"}'
    assert index.where(F.col("start") % 512 != 0).isEmpty()
