"""Readers of delimited, JSON and text files as rows with their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_text(columns: list[str]) -> Column:
    """``name: value; name: value`` over the columns that hold something."""
    return F.concat_ws("; ", *(F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in columns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, all columns as text, and their text form."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.withColumn("row_text", row_text(df.columns))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One VARIANT for each line; a line that is no JSON keeps its text with low confidence."""
    lines = spark.read.text(path)
    parsed = F.try_parse_json("value")
    return lines.select("value", parsed.alias("data"), F.when(parsed.isNull(), "low").otherwise("high").alias("confidence"))


def read_documents(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """Whole text files below a path: (path, text)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_seed(spark: SparkSession, path: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """Rows of the arrays of a JSON object, by name: for each table its schema; arrays that the file lacks are empty."""
    whole = spark.read.text(path, wholetext=True)
    schema = ", ".join(f"{name} array<struct<{fields}>>" for name, fields in tables.items())
    data = whole.select(F.from_json("value", schema).alias("d"))
    return {name: data.select(F.explode(F.col(f"d.{name}")).alias("r")).select("r.*") for name in tables}


def read_checked(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, length, problem) of the files (path, sha256) that a data set's manifest lists: missing and changed ones have a problem."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring("path", F.lit(1) + F.locate(folder.rstrip("/") + "/", F.col("path")) + F.lit(len(folder.rstrip("/"))), F.length("path"))
    files = held.select(name.alias("path"), "length", F.sha2("content", 256).alias("found"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.lower("sha256"), "changed")
    return manifest.join(files, "path", "left").select("path", "length", problem.alias("problem"))


def within_manifest(listing: DataFrame, include: list[str], exclude: list[str], suffixes: list[str], max_bytes: int = 250_000) -> DataFrame:
    """Files (path, length) of a corpus: included and not excluded by glob, of a listed suffix, not too long."""
    any_ = lambda globs: F.lit(False) if not globs else F.col("path").rlike("|".join(glob_pattern(g) for g in globs))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)
    return listing.where(any_(include) & ~any_(exclude) & suffix & (F.col("length") <= max_bytes)).dropDuplicates(["path"])


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over whole paths: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c != "/" else c), i + 1
    return f"(?:^|/){out}$"
