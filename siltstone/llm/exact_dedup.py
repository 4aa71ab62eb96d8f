"""Exact deduplication in skew-safe stages, with built-in expressions only.

1. Local and salted: rows are grouped by (digest, salt, full normalised text). Spark combines within
   each input partition first, and the salt (a hash of doc_id) spreads a hot text over many tasks.
2. Global: the salt winners of a digest meet, again compared by digest and full text, and each learns
   the winner of its group.
3. Back to the rows: (doc_id, digest, salt) joins the salt winners. A digest that stands for one text only, which
   stage 2 has proved by comparing texts, needs no text here; for a weak digest with several texts the rows'
   texts are compared (texts that share a SHA-256 digest would end the job). The salt keeps a hot digest's rows apart here too.

Salts follow from the row's number where ``row_col`` gives one, else from the id: give it where many ids are null or equal.
Ids are whole numbers of any width. Defined cases: a null text counts as empty; null doc_ids come last among candidates to stay; rows
repeated with the same doc_id are all members, count each and are all marked kept with the row that stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, columns


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 64,
    digest: Callable[[Column], Column] = sha256,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With ``row_col``, a unique whole number of each row, that column follows and exactly one row of a group is kept:
    among rows with one doc_id the one with the smallest number.

    Of equal normalised texts, the row with the most code points in the original, then the smallest
    id, stays. ``digest`` may be weak (tests use one that collides): full texts decide in any case.
    """
    rows = (
        columns(docs, doc_id=id_col, text=text_col, **({"row": row_col} if row_col else {}))
        .withColumn("row", F.col("row") if row_col else F.lit(0).cast("long"))
        .select("doc_id", "row", F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("body"))
        .withColumn("digest", digest(F.col("body")))
        .withColumn("salt", F.pmod(F.xxhash64("row" if row_col else "doc_id"), F.lit(salts)).cast("int"))
    )
    # Among equals the largest (n, some, not id) stays: ~id reverses the order of ids, null ids come last.
    rank = F.struct(F.col("n").alias("n"), F.col("doc_id").isNotNull().alias("some"), F.bitwise_not("doc_id").alias("flip"), (-F.col("row")).alias("back"))
    local = (
        rows.groupBy("digest", "salt", "body")
        .agg(F.count("*").alias("size"), F.max(rank).alias("best"))
    )
    # One exchange on the digest: its salt winners (at most ``salts`` for each text) learn their group's winner.
    text, digests = Window.partitionBy("digest", "body"), Window.partitionBy("digest")
    seats = (
        local.repartition("digest")
        .withColumns({"group_size": F.sum("size").over(text), "best": F.max("best").over(text)})
        .withColumn("single", F.min("body").over(digests) == F.max("body").over(digests))
        .select("digest", "salt", "body", "single", "group_size", F.bitwise_not("best.flip").alias("keep_id"), (-F.col("best.back")).alias("keep_row"))
    )
    found = rows.select("doc_id", "row", "digest", "salt").join(seats.drop("body") if digest is sha256 else seats.where("single").drop("body"), ["digest", "salt"])
    if digest is sha256:  # no two texts are known to share it; if stage 2 ever finds such texts, fail rather than mix them up
        found = found.withColumn("group_size", F.when(F.col("single"), F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest"))))
    else:
        clash = rows.select("doc_id", "row", "digest", "salt", "body").join(seats.where("not single"), ["digest", "salt", "body"])
        found = found.unionByName(clash.drop("body"))
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )
