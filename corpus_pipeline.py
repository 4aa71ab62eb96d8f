"""Corpus preparation as stages over ``documents``; each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bpe import encode_decode
from siltstone.llm.common import MADE, drop_path, scratch, tokenizer_file, written
from siltstone.llm.exact_dedup import exact_groups
from siltstone.llm.minhash import near_duplicates
from siltstone.llm.mixing import mix
from siltstone.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


KEY = "_row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a unique number each, written so that it stays; stages decide on rows, whatever their doc_id."""
    return written(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored as toxic go; all others stay. Null and repeated ids: each row by its own text."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, also among rows with null or equal ids."""
    rows = keyed(docs)
    gone = exact_groups(rows, row_col=KEY).where("not kept").select(KEY)
    return rows.join(gone, KEY, "left_anti").select(*docs.columns)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near duplicates one row stays, the one with the smallest id (null last); rows with one id are rows of their own."""
    rows = keyed(docs)
    found = near_duplicates(rows, id_col=KEY).select(F.col("doc_id").alias(KEY), "component_id").join(rows.select(KEY, "doc_id"), KEY)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY))
    stay = found.groupBy("component_id").agg(first.alias("first")).select(f"first.{KEY}")
    return rows.join(stay, KEY, "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or dropped so that the sources reach their target weights; null and repeated ids are rows like others."""
    rows = keyed(docs)
    times = mix(rows, row_col=KEY).where("times > 0").select(KEY, F.col("times").alias("_times"))
    return (
        rows.join(times, KEY)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*docs.columns)
    )


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, for each document of the mix."""
    return encode_decode(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", minhash),
    ("mix_sources", mixed),
    ("bpe", bpe),
]

#: The stages learn, group iteratively and encode, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read back.

    Once a stage's result is written, what it was made from (the stage before and its scratch tables) is deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = set(MADE)
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        for done in set(MADE) - before - {path}:
            drop_path(spark, done)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
