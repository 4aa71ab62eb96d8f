"""Entity mentions and their resolution to graph nodes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import map_rows
from ..functions import text as T
from ..shipping import ship
from .matching import matching_texts

# Confidences of the ways a mention is found, and scores of the ways it is resolved.
ALIAS_CONFIDENCE, NAME_CONFIDENCE, PATTERN_CONFIDENCE = 0.96, 0.92, 0.45
HINT_SCORE, EXACT_SCORE, FUZZY_FROM = 0.99, 0.97, 0.90
CAPITALISED = r"\b(?:[A-Z][A-Za-z0-9&'.-]+(?:\s+|$)){2,5}"


def graph_entities(nodes: DataFrame, aliases: DataFrame, min_len: int = 3) -> DataFrame:
    """Names and aliases of live nodes by normalised text, one row for each node and text, a name before an alias."""
    live = nodes.where(T.is_live(F.col("status")))
    names = live.select(F.col("id").alias("node_id"), "type", "name", F.col("name").alias("alias"), F.lit("name").alias("origin"))
    more = live.join(aliases, live["id"] == aliases["node_id"]).select(
        F.col("id").alias("node_id"), "type", "name", "alias", F.lit("alias").alias("origin")
    )
    rows = names.unionByName(more).withColumn("normalized", T.normalize_entity(F.col("alias"))).where(F.length("normalized") >= min_len)
    w = Window.partitionBy("node_id", "normalized").orderBy(F.col("origin").desc(), "alias")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _spans(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Where each text's candidate names stand in it; a name's pattern is compiled once by each task."""
    pattern = lru_cache(1 << 16)(lambda alias: re.compile(rf"(?<![A-Za-z0-9_]){re.escape(alias.strip())}(?![A-Za-z0-9_])", re.IGNORECASE))
    for chunk, text, names in rows:
        for name in names:
            for m in pattern(name["alias"]).finditer(text):
                yield chunk, name["node_id"], name["alias"], name["origin"], m.start(), m.end()


def key_word(c: Column) -> Column:
    """The longest word of a name (the first of these): seldom a common one."""
    words = F.split(T.normalize_text(c), " ")
    return F.get(F.filter(words, lambda w: F.length(w) == F.array_max(F.transform(words, lambda x: F.length(x)))), 0)


def known_mentions(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions of known entities with their offsets: (chunk_id, node_id, alias, start, end, confidence).

    An alias is a candidate for a chunk when its longest word occurs there: an equi-join on that word, so no
    chunk meets every alias. A chunk's candidates come to its text as one row, and the match with its boundaries runs on them only.
    """
    words = chunks.select("chunk_id", F.explode(F.array_distinct(F.split(T.normalize_text(F.col("text")), " "))).alias("word")).where("word != ''")
    keys = entities.select("node_id", "alias", "origin", key_word(F.col("alias")).alias("word"))
    names = words.join(keys, "word").groupBy("chunk_id").agg(F.collect_set(F.struct("node_id", "alias", "origin")).alias("names"))
    held = F.filter("names", lambda n: F.contains(F.lower("text"), F.lower(F.trim(n["alias"]))))
    rows = chunks.select("chunk_id", "text").join(names, "chunk_id").withColumn("names", held).where(F.size("names") > 0)
    spans = map_rows(
        rows.select("chunk_id", "text", "names"), _spans, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, node_id string, alias string, origin string, start int, end int"
    )
    best = Window.partitionBy("chunk_id", "node_id", "start", "end").orderBy(F.length("alias").desc(), "alias")
    return (
        spans.withColumn("rn", F.row_number().over(best))
        .where("rn = 1")
        .select("chunk_id", "node_id", "alias", "start", "end", F.when(F.col("origin") == "alias", ALIAS_CONFIDENCE).otherwise(NAME_CONFIDENCE).alias("confidence"))
    )


def pattern_mentions(chunks: DataFrame) -> DataFrame:
    """Runs of two to five capitalised words: (chunk_id, surface, confidence)."""
    found = F.transform(F.regexp_extract_all(F.col("text"), F.lit(CAPITALISED), F.lit(0)), T.strip)
    rows = chunks.select("chunk_id", F.explode(found).alias("surface")).where(F.length("surface") >= 4)
    return rows.withColumn("confidence", F.lit(PATTERN_CONFIDENCE))


def resolution_candidates(mentions: DataFrame, entities: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(mention_id, node_id, score, method): the best match of each node for a mention (mention_id, normalized, hint).

    A hint and an equal text are equi-joins. Distinct texts that are close meet in ``matching_texts``, the mention's first.
    """
    e = entities.select("node_id", "normalized").distinct()
    hint = mentions.where("hint is not null").join(e.select("node_id").distinct(), F.col("hint") == F.col("node_id"))
    out = hint.select("mention_id", "node_id", F.lit(HINT_SCORE).alias("score"), F.lit("extractor_hint").alias("method"))
    exact = mentions.where("normalized != ''").join(e, "normalized")
    out = out.unionByName(exact.select("mention_id", "node_id", F.lit(EXACT_SCORE).alias("score"), F.lit("exact_alias").alias("method")))
    if fuzzy:
        m = mentions.select("mention_id", F.col("normalized").alias("text"))
        n = e.select("node_id", F.col("normalized").alias("text"))
        near = matching_texts(m, n, FUZZY_FROM).where(F.col("left") != F.col("right"))
        near = near.join(m.withColumnRenamed("text", "left"), "left").join(n.withColumnRenamed("text", "right"), "right")
        out = out.unionByName(near.select("mention_id", "node_id", F.col("ratio").alias("score"), F.lit("fuzzy_alias").alias("method")))
    w = Window.partitionBy("mention_id", "node_id").orderBy(F.col("score").desc(), "method")
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def resolve(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(mention_id, status, node_id): accepted with one sure match or a clear winner, else for review or unresolved."""
    w = Window.partitionBy("mention_id").orderBy(F.col("score").desc(), "node_id")
    ranked = candidates.withColumns({"rn": F.row_number().over(w), "second": F.lead("score").over(w), "n": F.count("*").over(Window.partitionBy("mention_id"))})
    top = ranked.where("rn = 1")
    sure = (F.col("n") == 1) & (F.col("score") >= 0.95) & F.col("method").isin("exact_alias", "extractor_hint")
    clear = (F.col("n") > 1) & (F.col("score") >= 0.95) & (F.col("second") < 0.95) & (F.col("score") - F.col("second") >= 0.10)
    decided = top.select("mention_id", F.when(sure | clear, "accepted").otherwise("needs_review").alias("status"), "node_id")
    return mentions.select("mention_id").join(decided, "mention_id", "left").select("mention_id", F.coalesce("status", F.lit("unresolved")).alias("status"), "node_id")


def mention_hints(mentions: DataFrame, limit: int = 10) -> DataFrame:
    """Entities of accepted mentions (node_id, normalized, confidence, annotation) by their number: min(1, .65 + .05 n)."""
    each = mentions.groupBy("node_id", "normalized").agg(
        F.count("*").alias("n"), F.max("annotation").alias("annotation"), F.max_by("confidence", "annotation").alias("confidence")
    )
    w = Window.partitionBy("node_id").orderBy(F.desc("n"), F.desc("confidence"), "normalized")
    best = each.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select("node_id", "normalized", "n", "annotation", F.least(F.lit(1.0), 0.65 + 0.05 * F.col("n")).alias("score")).orderBy(F.desc("n"), "node_id").limit(limit)


def unscanned(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks without a mention of the same text hash: what a changed-only run still has to do."""
    return chunks.join(mentions.select("chunk_id", "text_hash").distinct(), ["chunk_id", "text_hash"], "left_anti")


def top_chunks_per_entity(mentions: DataFrame, k: int) -> DataFrame:
    per = mentions.groupBy("node_id", "chunk_id").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    w = Window.partitionBy("node_id").orderBy(F.desc("confidence"), F.desc("n"), "chunk_id")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


ship(__name__)
