"""Bundles: validation, differences by digest tree, compilation of changed rows only, verification and activation."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import bundles
from siltstone.sources.store import Conflict, Store

SCHEMA = "anchor_id string, scope map<string,string>, authoritative_source string, freshness_sla_hours int, status string"


def anchors_of(spark, n=300, **changed):
    rows = [(f"a{i}", {"claim_type": f"t{i % 7}", "client_id": "*"}, changed.get(f"a{i}", "crm"), 24, "active") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return sorted((str(p.relative_to(path)), p.stat().st_mtime_ns) for p in path.rglob("*") if p.is_file())


def test_errors_of_anchors(spark):
    rows = [("a", {"x": "y"}, "crm", 1, "active"), ("a", {}, "crm", 1, "active"), (None, {"x": "y"}, "", 0, "active"), ("b", None, None, None, None)]
    got = {(r.anchor_id, r.error) for r in bundles.anchor_errors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        ("a", "scope is required"), ("a", "duplicate anchor id"), ("", "anchor id is required"), ("", "authoritative_source is required"),
        ("", "freshness_sla_hours must be positive"), ("b", "scope is required"), ("b", "authoritative_source is required"), ("b", "freshness_sla_hours must be positive"),
    }


def test_trees_lead_to_what_has_changed(spark, monkeypatch):
    old = anchors_of(spark)
    new = anchors_of(spark, 301, a17="ads").where("anchor_id != 'a250'")
    trees = [bundles.digest_tree(df, "anchor_id", 2) for df in (old, new)]
    assert bundles.root_of(trees[0]) == bundles.root_of(bundles.digest_tree(old.repartition(3).orderBy(F.desc("anchor_id")), "anchor_id", 2)) != bundles.root_of(trees[1])
    leaves = bundles.differing_leaves(*trees, 2)
    want = {r[0] for r in spark.createDataFrame([("a17",), ("a250",), ("a300",)], "k string").select(bundles.leaf_of(F.col("k"), 2)).collect()}
    assert set(leaves) == want and len(leaves) <= 3
    got = {(r.key, r.change) for r in bundles.changed_rows(old, new, "anchor_id", *trees, 2).collect()}
    assert got == {("a17", "changed"), ("a250", "removed"), ("a300", "added")}
    assert bundles.differing_leaves(trees[0], trees[0], 2) == []
    monkeypatch.setattr(bundles, "LEAF_ROWS", 10)
    assert bundles.leaf_digits(300) == 2 and bundles.leaf_digits(0) == 1
    assert bundles.digest_tree(old, "anchor_id").where("prefix = ''").first().n == 300


def test_a_bundle_is_compiled_by_its_changed_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/registry", 16)
    first = bundles.compile_bundle(store, "main", 1, anchors_of(spark))
    assert first["changed"] == 300 and bundles.verify(store, "main", anchors_of(spark))["status"] == "ok"
    before = files(tmp_path)
    assert bundles.compile_bundle(store, "main", 1, anchors_of(spark)) == first | {"changed": 0} and files(tmp_path) == before
    old = store.last_commit()["tables"]["anchors-main"]["versions"]
    later = anchors_of(spark, a17="ads")
    assert bundles.verify(store, "main", later)["status"] == "stale"
    second = bundles.compile_bundle(store, "main", 2, later)
    new = store.last_commit()["tables"]["anchors-main"]["versions"]
    assert second["changed"] == 1 and second["bundle_hash"] != first["bundle_hash"] and sum(old[b] != new[b] for b in old) == 1
    assert store.read("anchors-main").where("anchor_id = 'a17'").first().authoritative_source == "ads" and store.read("anchors-main").count() == 300


def test_a_failed_activation_leaves_the_old_bundle(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/registry", 4)
    assert bundles.active_anchors(store) is None and bundles.verify(store, "main")["status"] == "missing"
    bundles.compile_bundle(store, "main", 1, anchors_of(spark, 20))
    bundles.activate(store, "main")
    with pytest.raises(ValueError, match="missing"):
        bundles.activate(store, "other")
    with pytest.raises(ValueError, match="duplicate anchor id"):
        bundles.compile_bundle(store, "other", 1, anchors_of(spark, 3).unionByName(anchors_of(spark, 1)))
    assert bundles.active_anchors(store).count() == 20
    bundles.compile_bundle(store, "other", 1, anchors_of(spark, 5))
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda *a: (_ for _ in ()).throw(Conflict("another writer")))
        with pytest.raises(Conflict):
            bundles.activate(store, "other")
    assert bundles.active_anchors(store).count() == 20
    bundles.activate(store, "other")
    assert bundles.active_anchors(store).count() == 5
    damaged = store.last_commit()
    last, stamp = store.begin()
    store.stage("anchors-main", stamp, store.read("anchors-main", damaged, [0]).limit(0), ["anchor_id"])
    store.commit(last, stamp, [0])
    assert bundles.verify(store, "main")["status"] == "damaged"
    with pytest.raises(ValueError, match="damaged"):
        bundles.activate(store, "main")
