"""Authority bundles: validation, compilation into a registry, differences by digest tree, verification and activation.

A digest tree hashes rows by the hex digits of their key's hash: a leaf the hashes of its rows in order, a node its children in order, so two states
differ below a node exactly where its digests do. What has changed is found from the root down, and rows are compared in the leaves that
differ only. A registry is a ``Store``: a bundle's rows and tree become visible by one commit, and so does which bundle is active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from ..sources.store import Store

LEAF_ROWS = 1000
DIFFERENCE = "key string, change string"


def anchor_errors(anchors: DataFrame) -> DataFrame:
    """(anchor_id, error) of anchors (anchor_id, scope map, authoritative_source, freshness_sla_hours): what keeps a bundle from being compiled."""
    name = F.coalesce("anchor_id", F.lit(""))
    checks = {
        "anchor id is required": name == "",
        "scope is required": F.coalesce(F.size("scope"), F.lit(0)) <= 0,
        "authoritative_source is required": F.coalesce("authoritative_source", F.lit("")) == "",
        "freshness_sla_hours must be positive": F.coalesce("freshness_sla_hours", F.lit(0)) <= 0,
    }
    found = anchors.select(name.alias("anchor_id"), F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(text)) for text, bad in checks.items())))).alias("error"))
    twice = anchors.groupBy(name.alias("anchor_id")).agg(F.count("*").alias("n")).where("n > 1 AND anchor_id != ''")
    return found.unionByName(twice.select("anchor_id", F.lit("duplicate anchor id").alias("error")))


def row_hash(rows: DataFrame) -> Column:
    """Hash of a row as JSON with its columns by name and its maps by key; nulls are left out."""

    def value(f):
        return F.array_sort(F.map_entries(f.name)).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name)

    return F.sha2(F.to_json(F.struct(*(value(f) for f in sorted(rows.schema.fields, key=lambda f: f.name)))), 256)


def leaf_digits(n: int) -> int:
    """Hex digits of a leaf, for leaves of some ``LEAF_ROWS`` rows."""
    digits = 1
    while 16**digits * LEAF_ROWS < n:
        digits += 1
    return digits


def leaf_of(key: Column, digits: int) -> Column:
    return F.substring(F.sha2(key.cast("string"), 256), 1, digits)


def digest_tree(rows: DataFrame, key: str, digits: int | None = None) -> DataFrame:
    """(prefix, digest, n) of all nodes: the root under the empty prefix, leaves under ``digits`` hex digits."""
    digits = digits or leaf_digits(rows.count())
    hashed = rows.select(leaf_of(F.col(key), digits).alias("prefix"), row_hash(rows).alias("digest"))
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest")
    level = written(hashed.groupBy("prefix").agg(joined, F.count("*").alias("n")), "leaves")
    tree = level
    for length in range(digits - 1, -1, -1):
        below = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat_ws(":", x["prefix"], x["digest"])), "|")
        level = level.groupBy(F.substring("prefix", 1, length).alias("prefix")).agg(F.sha2(below, 256).alias("digest"), F.sum("n").alias("n"))
        tree = tree.unionByName(level)
    return tree


def root_of(tree: DataFrame) -> str:
    """The digest of all rows; of no rows the empty text's."""
    found = tree.where("prefix = ''").select("digest").first()
    return found[0] if found else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def differing_leaves(old: DataFrame, new: DataFrame, digits: int) -> list[str]:
    """Prefixes of the leaves that differ between two trees, from the root down; only children of nodes that differ are looked at."""
    differ: list[str] = [""]
    for length in range(digits + 1):
        at = lambda tree: tree.where((F.length("prefix") == length) & F.substring("prefix", 1, max(length - 1, 0)).isin(differ))  # noqa: B023, E731
        both = at(old).select("prefix", F.col("digest").alias("was")).join(at(new).select("prefix", "digest"), "prefix", "full")
        differ = sorted(r[0] for r in both.where("NOT was <=> digest").select("prefix").collect())
        if not differ:
            return []
    return differ


def changed_rows(old: DataFrame, new: DataFrame, key: str, old_tree: DataFrame, new_tree: DataFrame, digits: int) -> DataFrame:
    """(key, change) of rows that were added, removed or changed; rows outside of differing leaves are never compared.

    The driver holds the prefixes of the leaves that differ, one for some ``LEAF_ROWS`` rows of what has changed at most.
    """
    leaves = differing_leaves(old_tree, new_tree, digits)
    side = lambda rows, name: rows.where(leaf_of(F.col(key), digits).isin(leaves)).select(F.col(key).cast("string").alias("key"), row_hash(rows).alias(name))
    both = side(old, "was").join(side(new, "now"), "key", "full").where("NOT was <=> now")
    return both.select("key", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def compile_bundle(store: Store, bundle_id: str, version: int, anchors: DataFrame, digits: int = 2) -> dict:
    """Validate a bundle's anchors and make them its content in the registry, with their tree; nothing is written where they are unchanged.

    Returns bundle_id, version, bundle_hash and the number of changed rows. An invalid bundle is refused and the registry stays as it was.
    """
    problems = [f"{r.anchor_id}: {r.error}" for r in anchor_errors(anchors).orderBy("anchor_id", "error").limit(20).collect()]
    problems += ["bundle_id is required"] * (not bundle_id) + ["version must be positive"] * (version <= 0)
    if problems:
        raise ValueError("invalid bundle: " + "; ".join(problems))
    last, stamp = store.begin()
    table, trees = f"anchors-{bundle_id}", f"tree-{bundle_id}"
    tree = written(digest_tree(anchors, "anchor_id", digits), "tree")
    old, old_tree = store.read(table, last), store.read(trees, last)
    if old is None:
        changes = anchors.select(F.col("anchor_id").alias("key"), F.lit("added").alias("change"))
    else:
        changes = changed_rows(old.drop("bucket"), anchors, "anchor_id", old_tree, tree, digits)
    changes = written(changes.withColumn("bucket", store.bucket_of(F.col("key"))), "changes")
    known = {} if (held := store.read("bundles", last)) is None else {r.bundle_id: r for r in held.collect()}  # one row for each bundle
    result = {"bundle_id": bundle_id, "version": version, "bundle_hash": root_of(tree), "changed": changes.count()}
    if bundle_id in known and not result["changed"] and known[bundle_id].version == version:
        return result
    touched = sorted(r[0] for r in changes.select("bucket").distinct().collect())
    bucket = store.bucket_of(F.col("anchor_id"))
    store.stage(table, stamp, anchors.withColumn("bucket", bucket).where(F.col("bucket").isin(touched)), ["anchor_id"])
    number = store.commit(last, stamp, touched)
    # the tree and the record follow under a commit of their own; until then verify() calls the registry stale
    last, stamp = store.begin()
    store.stage(trees, stamp, tree.withColumn("bucket", F.lit(0)), ["prefix"])
    rows = [(r.bundle_id, r.version, r.bundle_hash, 0) for b, r in known.items() if b != bundle_id] + [(bundle_id, version, result["bundle_hash"], 0)]
    store.stage("bundles", stamp, store.spark.createDataFrame(rows, "bundle_id string, version int, bundle_hash string, bucket int"), ["bundle_id"])
    if last["number"] != number:
        raise RuntimeError("another writer has committed between a bundle's rows and its record")
    store.commit(last, stamp, [0])
    return result


def verify(store: Store, bundle_id: str, anchors: DataFrame | None = None) -> dict:
    """Whether the registry's rows of a bundle have its recorded hash and, with ``anchors``, whether these do: ok, stale, missing or damaged."""
    held, rows = store.read("bundles"), store.read(f"anchors-{bundle_id}")
    record = held.where(F.col("bundle_id") == bundle_id).first() if held is not None else None
    if record is None or rows is None:
        return {"status": "missing", "ok": False}
    digits = store.read(f"tree-{bundle_id}").agg(F.max(F.length("prefix"))).first()[0] or 1
    stored = root_of(digest_tree(rows.drop("bucket"), "anchor_id", digits))
    if stored != record.bundle_hash:
        return {"status": "damaged", "ok": False, "expected_hash": record.bundle_hash, "actual_hash": stored}
    expected = stored if anchors is None else root_of(digest_tree(anchors, "anchor_id", digits))
    return {"status": "ok" if expected == stored else "stale", "ok": expected == stored, "expected_hash": expected, "actual_hash": stored}


def activate(store: Store, bundle_id: str) -> int:
    """Make a bundle the active one by a commit of its own; a bundle that isn't whole is refused and the old one stays."""
    state = verify(store, bundle_id)
    if not state["ok"]:
        raise ValueError(f"bundle {bundle_id} can't be activated: {state['status']}")
    last, stamp = store.begin()
    store.stage("active", stamp, store.spark.createDataFrame([(bundle_id, 0)], "bundle_id string, bucket int"), ["bundle_id"])
    return store.commit(last, stamp, [0])


def active_anchors(store: Store) -> DataFrame | None:
    """The anchors of the active bundle, read under one commit; None where none is active."""
    commit = store.last_commit()
    active = store.read("active", commit)
    if active is None:
        return None
    return store.read(f"anchors-{active.first().bundle_id}", commit).drop("bucket")
