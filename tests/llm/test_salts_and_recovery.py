"""Null and repeated ids at size, and inputs whose rows a lost task would find in another order."""

import collections

import pytest
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, mixing, token_store
from siltstone.llm.common import from_files, scratch, tokenizer_file

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_copies_with_null_ids_are_spread_by_their_row(spark):
    """Ten thousand copies of one text without ids: one stays, and the rows are dealt to many salts."""
    rows = spark.range(10_000).select(F.col("id").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("one text"), F.repeat(F.lit(" "), (F.col("id") % 3).cast("int"))).alias("text"))
    got = exact_dedup.exact_groups(rows, row_col="row")
    assert got.where("kept").collect()[0].row == 2 and got.where("kept").count() == 1 and got.count() == 10_000
    assert got.select("group_size").distinct().collect() == [(10_000,)]
    salted = rows.select(F.pmod(F.xxhash64("row"), F.lit(64)).alias("salt")).groupBy("salt").count()
    assert salted.count() == 64 and salted.agg(F.max("count")).first()[0] < 300


@pytest.mark.parametrize("ids", ["null", "repeated"])
def test_targets_are_met_without_ids(documents, ids):
    docs = documents.withColumn("doc_id", F.lit(None if ids == "null" else 7).cast("long"))
    taken, target = collections.Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target), {s: taken[s] / target[s] for s in target}


def test_token_store_writes_inputs_that_come_from_no_file(spark, documents, monkeypatch):
    """Rows of a shuffle have an order of their own in every run; they are written before they are numbered."""
    assert from_files(documents) and not from_files(documents.repartition(4).unionByName(documents)) and not from_files(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    made = []
    monkeypatch.setattr(token_store, "written", lambda df, label, real=token_store.written: made.append(label) or real(df, label))
    shuffled = documents.select("doc_id", "text").repartition(5, "doc_id").unionByName(spark.createDataFrame([(10**6, "more")], "doc_id long, text string"))
    found = []
    for _ in range(2):
        out = scratch(spark, "test-tokens")
        manifest = token_store.materialise(shuffled, out, tokenizer_file("byte_bpe_50k.tiktoken"), key=3, length=64, per_shard=500)
        rows = token_store.read_sequences(manifest, out, length=64).select("slot", "doc_id", "seq_no", "ids_sha256").collect()
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        found.append(sorted((r.doc_id, r.seq_no, r.ids_sha256) for r in rows))
    assert made == ["texts", "texts"] and found[0] == found[1]


def test_shards_are_bounded_in_number(spark, documents, monkeypatch):
    monkeypatch.setattr(token_store, "MOST_SHARDS", 1)
    out = scratch(spark, "test-tokens")
    assert token_store.materialise(documents, out, tokenizer_file("byte_bpe_50k.tiktoken"), length=8).count() == 1
