"""Append-only tables that a source's captures, evidence cards and cached results go to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ledger import duplicate_groups
from ..shared import checkpointed, path_exists


def append_new(rows: DataFrame, path: str, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Append the rows whose keys the table at ``path`` lacks, one for each key; returns what was appended.

    Of several rows with one key, the one whose values, read as JSON, are the greatest is taken.
    """
    if path_exists(rows.sparkSession, path):  # what is there already is neither compared nor moved
        rows = rows.join(rows.sparkSession.read.parquet(path).select(*keys).distinct(), keys, "left_anti").select(*rows.columns)
    last = F.max_by(F.struct(*rows.columns), F.to_json(F.struct(*rows.columns)))
    new = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(last.alias("r")).select("r.*")
    new = checkpointed(new)  # what is appended must not depend on the table it is appended to
    writer = new.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return new


def capture_rows(rows: DataFrame) -> DataFrame:
    """Captures of (source_id, url, title, text, captured_at): id, raw and normalised text, summary, hashes and metadata."""
    text = T.normalize_structured(T.text_or_empty("text"))
    digest = F.sha2(text, 256)
    return rows.select(
        T.stable_id("capture", F.col("source_id"), digest).alias("capture_id"),
        "source_id", "url", F.coalesce("title", T.title_of(F.coalesce("url", F.lit("")), text)).alias("title"),
        T.text_or_empty("text").alias("raw"), text.alias("text"), T.summary_of(text).alias("summary"), digest.alias("content_hash"), "captured_at",
    )


def capture(rows: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Write new captures below ``root`` and return them, with links (key, keep_id, id) of captures that hold one text.

    A capture of unchanged text is not written again, so captures of a source are its versions.
    """
    new = append_new(capture_rows(rows), f"{root}/captures", ["capture_id"])
    known = rows.sparkSession.read.parquet(f"{root}/captures")
    return new, duplicate_groups(known, F.col("content_hash"), "capture_id")


def write_cards(cards: DataFrame, root: str) -> DataFrame:
    """Append new evidence cards below ``root``, in a folder for each client."""
    return append_new(cards, f"{root}/cards", ["evidence_id"], ["client_id"])


def cache_key(body: Column, model: str, options: str = "") -> Column:
    """Key of a result that follows from a body, a model and its options alone."""
    return F.sha2(F.concat_ws("|", F.sha2(body, 256), F.lit(model), F.lit(options)), 256)


def cached(rows: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with their results: those at ``path`` are looked up, the others computed and appended. ``compute`` keeps ``key``."""
    spark = rows.sparkSession
    missing = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if path_exists(spark, path) else rows
    append_new(compute(missing.dropDuplicates([key])), path, [key])
    return rows.join(spark.read.parquet(path), key)
