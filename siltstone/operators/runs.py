"""Runs that write what they find: relation extraction over changed chunks, and the resolution of review items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written
from ..sources.store import Store
from .relations import extract_relations, normalize_predicate
from .text_index import compared

EXTRACTOR = "rules"
PIECE_BYTES = 1 << 22


def extraction_run(store: Store, chunks: DataFrame, terms: DataFrame, extract: Callable[[DataFrame], DataFrame] = extract_relations, extractor: str = EXTRACTOR) -> DataFrame:
    """Extract relations from the chunks (chunk_id, text) that are new or changed; returns (chunk_id, state) of this run.

    The store keeps an annotation and a candidate for each claim of a chunk. A changed chunk's rows are replaced, those of a chunk that is gone
    go, and buckets without either stay as they are. A claim that a chunk makes several times is one. Candidates start as "candidate".
    Texts are dealt out before they are read, so the tasks don't depend on how the chunks lie in files; they are read once, and claims are
    written to pieces of buckets of some ``PIECE_BYTES`` of text, of which both tables are made without another shuffle.
    """
    last, version = store.begin()
    states = written(compared(store, chunks.select(F.col("chunk_id").alias("doc_id"), "text"), last), "states")
    moved = states.where("state != 'unchanged'")
    sizes = states.groupBy("bucket").agg(F.count_if(F.col("state") != "unchanged").alias("moved"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).where("moved > 0").collect()
    touched = sorted(r["bucket"] for r in sizes)
    shown = states.select(F.col("doc_id").alias("chunk_id"), "state")
    if not touched:
        return shown
    pieces = max(1, -(-max(r["bytes"] for r in sizes) // PIECE_BYTES))
    deal = lambda rows, own: store.deal(rows, F.col(own), pieces)
    fresh = chunks if not last["tables"].get("documents") else chunks.join(moved.where("state != 'gone'").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    key = ["chunk_id", "subject", "predicate", "object"]
    claims = normalize_predicate(extract(fresh.repartition(store.buckets * pieces, "chunk_id")), terms).withColumn("bucket", store.bucket_of(F.col("chunk_id")))
    claims = written(deal(claims, "chunk_id").dropDuplicates(["bucket", "piece", *key]).drop("piece"), "claims")
    parts = [F.col(c).cast("string") for c in key]
    claims = claims.withColumn("annotation_id", T.stable_id("annotation", F.lit("relation_claim"), F.lit(extractor), *parts))
    annotations = claims.select(
        "chunk_id", "annotation_id", F.lit("relation_claim").alias("annotation_type"), F.to_json(F.struct(*key[1:], "subject_type", "object_type")).alias("extracted"),
        "confidence", F.lit("candidate").alias("status"), F.lit(extractor).alias("extractor"), "bucket",
    )
    candidates = claims.select(
        "chunk_id", T.stable_id("relation", *parts).alias("candidate_id"), "annotation_id", "subject", "predicate", "object", "subject_type", "object_type",
        "confidence", F.lit("candidate").alias("status"), "bucket",
    )
    records = moved.where("state != 'gone'").select("doc_id", "digest", "bucket")
    for name, rows, own in (("annotations", annotations, "chunk_id"), ("candidates", candidates, "chunk_id"), ("documents", records, "doc_id")):
        rows = rows if name != "documents" else deal(rows, own).drop("piece")
        old = store.read(name, last, touched)
        if old is not None:
            marks = moved.select(F.col("doc_id").alias(own), "bucket", F.lit(True).alias("moved"))
            left = F.max("moved").over(Window.partitionBy("bucket", "piece", own))  # where the rows are dealt to, so they move once
            rows = rows.unionByName(deal(old.unionByName(marks, True), own).withColumn("moved", left).where("moved IS NULL").drop("moved", "piece"))
        store.stage(name, version, rows, [own], dealt=True)
    store.commit(last, version, touched)
    return shown


def resolve_reviews(items: DataFrame, decisions: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Review items (review_id, candidate_id, status, notes map) after decisions (review_id, status, resolution, notes), and a row for each decision.

    Of several decisions on an item the last in the order of their values holds, all are logged; those on unknown items are neither. A
    resolution and notes go to the item's notes unless they are empty.
    """
    known = decisions.join(items.select("review_id", "candidate_id", F.col("status").alias("before")), "review_id")
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    log = known.select(
        T.stable_id("decision", F.col("review_id").cast("string"), F.col("status"), value("resolution"), value("notes"), F.lit(at)).alias("decision_id"),
        "review_id", "candidate_id", "before", F.col("status").alias("after"), value("resolution").alias("resolution"), value("notes").alias("notes"),
    ).distinct()
    last = known.groupBy("review_id").agg(F.max(F.struct(F.col("status").alias("s"), value("resolution").alias("r"), value("notes").alias("n"))).alias("d"))
    added = F.map_filter(F.create_map(F.lit("resolution"), F.col("d.r"), F.lit("notes"), F.col("d.n")), lambda k, v: v != "")
    kept = F.map_filter(F.coalesce("notes", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(added, k))
    changed = items.join(last, "review_id", "left")
    return changed.select(
        "review_id", "candidate_id", F.coalesce("d.s", "status").alias("status"),
        F.when(F.col("d").isNull(), F.col("notes")).otherwise(F.map_concat(kept, added)).alias("notes"),
    ), log
