"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the operators' contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def ship(name: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="siltstone-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in MADE:
        MADE.remove(path)


#: Scratch paths of this process that are still there.
MADE: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when the session's process ends."""
    path = f"{shared_dir(spark)}/siltstone-{label}-{uuid.uuid4().hex[:12]}"
    MADE.append(path)

    def clean() -> None:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM has gone already
            pass

    atexit.register(clean)
    return path


def written(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back; ``made`` collects the folders."""
    spark = df.sparkSession
    path = scratch(spark, label)
    if made is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def from_files(df: DataFrame) -> bool:
    """Whether all rows come from the files of one input, so that every task finds the same rows again in the same order."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.collectLeaves().size() != 1:
        return False
    return not any(r[0] == "" for r in df.select(F.input_file_name()).head(1))


def join_sized(rows: DataFrame, table: DataFrame, key: str, size: str, deal: list[str], share: int = 1000) -> DataFrame:
    """Left join of ``rows`` to ``table``: one row for each key with the number of ``rows`` that hold it.

    Keys that hold at least one of ``share`` of the rows that ``table`` counts are at most ``share`` keys: they are broadcast, so
    no task gets a hot key's rows. The others are joined by key. Rows of hot keys or none are dealt by the columns ``deal``.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    values = [c for c in table.columns if c not in (key, size)]
    least = max(1, -(-total // share))
    hot = table.where(F.col(size) >= least).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values))
    rest = table.where(F.col(size) < least).select(F.col(key).cast("binary").alias("_cold"), *values)
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # a random number in place of the key; no key has nine bytes with this first one
    none = F.concat(F.lit(b"\0"), F.unhex(F.lpad(F.hex(F.xxhash64(*rows.columns)), 16, "0")))
    dealt = dealt.withColumn("_at", F.when(F.col(key).isNull() | F.col("_hot").isNotNull(), none).otherwise(F.col(key).cast("binary")))
    return dealt.join(rest, F.col("_at") == F.col("_cold"), "left").select(
        *rows.columns, *(F.coalesce(F.col(c), F.col(f"_hot_{c}")).alias(c) for c in values)
    )


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Let the session send at most ``rows`` rows to Python at a time, fewer where it says so already.

    Arrow buffers live outside the heap on both sides, for every running task. Spark bounds them by rows
    alone; a thousand rows of usual texts are some megabytes.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns under internal names, so clashing extra columns do no harm."""
    return df.select(*(F.col(f"`{src}`").alias(dst) for dst, src in wanted.items()))


def count_words(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0.

    A word starts at a non-space that follows a space or the text's start, so words are counted
    as the pieces of the text after trimming and squeezing, without building a word array.
    """
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(squeezed) - F.length(F.replace(squeezed, F.lit("x"), F.lit("")))


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
