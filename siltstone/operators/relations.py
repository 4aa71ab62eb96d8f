"""Relations between entities: extraction by sentence patterns, promotion under an ontology, search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import text as T
from ..shipping import ship

# An entity's words, and for each relation its verbs and what stands before them.
WORD = r"[A-Z][A-Za-z0-9&'-]*"
ENTITY = rf"{WORD}(?:\s+(?:{WORD}|and|of|the)){{0,5}}"
BE, BE_A = r"(?:is|was|are|were)\s+", r"(?:is|was|are|were)\s+(?:a\s+)?"
PATTERNS = {
    "acquired": ("", ("acquired", "bought", "purchased")),
    "owned_by": (BE, ("owned by", "controlled by")),
    "led_by": (BE, ("led by", "headed by", "run by")),
    "customer_of": (BE_A, ("customer of", "client of")),
    "supplier_of": (BE_A, ("supplier of", "vendor for")),
    "partners_with": ("", ("partners with", "partnered with")),
    "competitor_of": ("", ("competes with",)),
    "based_in": (BE, ("based in", "located in", "headquartered in")),
    "part_of": (BE, ("part of", "division of", "subsidiary of")),
    "uses": ("", ("uses", "runs on", "standardized on")),
}
CONFIDENCE = 0.82
# The default ontology: aliases, subject types, object types, cardinality.
ONTOLOGY = {
    "acquired": ("acquired,bought,purchased", "organization,account,unknown", "organization,account,unknown", "many"),
    "owned_by": ("owned by,controlled by", "organization,product,account,unknown", "organization,person,account,unknown", "one"),
    "led_by": ("led by,headed by,run by", "organization,account,opportunity,unknown", "person,role,unknown", "one"),
    "customer_of": ("customer of,client of,buys from", "organization,account,unknown", "organization,product,unknown", "many"),
    "supplier_of": ("supplier of,vendor for,provides to", "organization,account,unknown", "organization,account,unknown", "many"),
    "partners_with": ("partners with,partnered with,partner of", "organization,account,person,unknown", "organization,account,person,unknown", "many"),
    "competitor_of": ("competitor of,competes with,rival of", "organization,product,account,unknown", "organization,product,account,unknown", "many"),
    "based_in": ("based in,located in,headquartered in", "organization,account,person,unknown", "location,unknown", "one"),
    "part_of": ("part of,division of,subsidiary of", "organization,account,product,unknown", "organization,account,unknown", "one"),
    "uses": ("uses,runs on,standardized on", "organization,account,person,unknown", "product,organization,unknown", "many"),
}


def pattern(predicate: str) -> str:
    before, verbs = PATTERNS[predicate]
    return rf"\b({ENTITY})\s+{before}({'|'.join(verbs)})\s+({ENTITY})\b"


def ontology(spark: SparkSession) -> DataFrame:
    """(predicate, aliases, subject_types, object_types, cardinality), ten rows."""
    rows = [(p, *(x.split(",") for x in spec[:3]), spec[3]) for p, spec in ONTOLOGY.items()]
    return spark.createDataFrame(rows, "predicate string, aliases array<string>, subject_types array<string>, object_types array<string>, cardinality string")


def extract_with(chunks: DataFrame, extractor: Callable[[str], list[tuple[str, str, str, float]]]) -> DataFrame:
    """Relations by a function of one text that gives (subject, predicate, object, confidence); types follow from names and predicates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *claim) for i, text in zip(pdf["chunk_id"], pdf["text"]) for claim in extractor(text or "")]
            yield pd.DataFrame(rows, columns=["chunk_id", "subject", "predicate", "object", "confidence"])

    kind = dict(chunks.dtypes)["chunk_id"]
    rows = chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {kind}, subject string, predicate string, object string, confidence double")
    return rows.select(
        "chunk_id", "subject", "predicate", "object",
        T.entity_type(F.col("subject"), F.col("predicate"), "subject").alias("subject_type"),
        T.entity_type(F.col("object"), F.col("predicate"), "object").alias("object_type"),
        "confidence",
    )


def extractor_function(extractor: Callable[[str], list[tuple[str, str, str, float]]], text_col: str = "text"):
    """The extractor as a table function: SELECT * FROM name(TABLE(chunks)), once it is registered with ``spark.udtf.register``.

    It takes any table with a ``text_col`` and gives its other columns with subject, predicate, object and confidence for each claim; rows without
    claims give none. Rows stay where they are unless the call says PARTITION BY.
    """

    class Extract:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or text_col not in rows.dataType.fieldNames():
                raise ValueError(f"the function takes a table with a column {text_col}")
            kept = [f for f in rows.dataType.fields if f.name != text_col]
            found = [StructField(c, StringType()) for c in ("subject", "predicate", "object")]
            return AnalyzeResult(schema=StructType([*kept, *found, StructField("confidence", DoubleType())]))

        def eval(self, row):
            kept = [row[c] for c in row.__fields__ if c != text_col]
            for claim in extractor(row[text_col] or ""):
                yield (*kept, *claim)

    return F.udtf(Extract)


def extract_relations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, subject, predicate, object, subject_type, object_type, confidence), one row for each match.

    All patterns run over a text in one projection, once: a plain explode would run them for a filter of its own, too. A pattern looks only at
    texts that hold one of its verbs.
    """

    def matches(p: str):
        one = lambda m: F.struct(
            F.lit(p).alias("predicate"),
            T.clean_entity(F.regexp_extract(m, pattern(p), 1)).alias("subject"),
            T.clean_entity(F.regexp_extract(m, pattern(p), 3)).alias("object"),
        )
        held = reduce(or_, (F.contains("text", F.lit(v)) for v in PATTERNS[p][1]))
        return F.when(held, F.transform(F.regexp_extract_all(F.col("text"), F.lit(pattern(p)), F.lit(0)), one))

    found = F.flatten(F.array_compact(F.array(*map(matches, PATTERNS))))
    rows = chunks.select("chunk_id", F.explode_outer(found).alias("r")).select("chunk_id", "r.*").where("subject != '' and object != ''")
    return rows.select(
        "chunk_id", "subject", "predicate", "object",
        T.entity_type(F.col("subject"), F.col("predicate"), "subject").alias("subject_type"),
        T.entity_type(F.col("object"), F.col("predicate"), "object").alias("object_type"),
        F.lit(CONFIDENCE).alias("confidence"),
    )


def normalize_predicate(rows: DataFrame, terms: DataFrame, column: str = "predicate") -> DataFrame:
    """A predicate's alias becomes its id; others become words joined by underscores. The terms are broadcast, as configuration."""
    known = terms.select(F.col("predicate").alias("_id"), F.explode(F.array_union("aliases", F.array("predicate"))).alias("_alias")).distinct()
    low = F.lower(F.trim(F.col(column)))
    out = rows.join(F.broadcast(known), low == F.col("_alias"), "left")
    return out.withColumn(column, F.coalesce("_id", F.regexp_replace(low, "[ -]+", "_"))).drop("_id", "_alias")


def promote(candidates: DataFrame, terms: DataFrame, accepted: DataFrame | None = None, min_confidence: float = 0.7) -> DataFrame:
    """Candidates (candidate_id, subject, predicate, object, types, confidence) with status and reason.

    A valid candidate of a one-valued predicate is accepted when its object is the first one accepted for the
    subject (by confidence, then id) and none that differs was accepted before.
    """
    key = T.normalize_entity(F.col("subject"))
    rows = candidates.join(terms.drop("aliases"), "predicate", "left").withColumns({"skey": key, "okey": F.lower("object")})
    reason = (
        F.when(F.col("cardinality").isNull(), F.lit("unknown_predicate"))
        .when(F.col("confidence") < min_confidence, F.lit("low_confidence"))
        .when(~F.array_contains("subject_types", F.col("subject_type")), F.lit("subject_type_not_allowed"))
        .when(~F.array_contains("object_types", F.col("object_type")), F.lit("object_type_not_allowed"))
    )
    rows = rows.withColumn("reason", reason)
    order = Window.partitionBy("skey", "predicate").orderBy(F.col("reason").isNotNull(), F.desc("confidence"), "candidate_id")
    rows = rows.withColumn("first", F.first(F.when(F.col("reason").isNull(), F.col("okey")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if accepted is not None:
        old = accepted.select(T.normalize_entity(F.col("subject")).alias("skey"), "predicate", F.lower("object").alias("held")).groupBy("skey", "predicate").agg(F.min("held").alias("held"))
        rows = rows.join(old, ["skey", "predicate"], "left").withColumn("first", F.coalesce("held", "first"))
    clash = F.col("reason").isNull() & (F.col("cardinality") == "one") & (F.col("first") != F.col("okey"))
    rows = rows.withColumn("reason", F.when(clash, F.lit("cardinality_conflict")).otherwise(F.col("reason")))
    return rows.select("candidate_id", F.when(F.col("reason").isNull(), "accepted").otherwise("needs_review").alias("status"), "reason")


def find_relations(edges: DataFrame, subject: str = "", predicate: str = "", obj: str = "", words: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """Accepted edges that hold all the given parts and words (at most six)."""
    hit = F.lit(True)
    for c, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if value:
            hit = hit & F.contains(F.lower(c), F.lit(value.lower()))
    all_text = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    for w in words[:6]:
        hit = hit & F.contains(all_text, F.lit(w.lower()))
    return edges.where(hit).orderBy(F.desc("confidence"), "subject", "predicate", "object").limit(limit)


def shared_relations(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(predicate, object_key) that two subjects have in common, with the best confidence of each side."""
    side = lambda name, x: (
        edges.where(T.normalize_entity(F.col("subject")) == T.normalize_entity(F.lit(name)))
        .groupBy("predicate", T.normalize_entity(F.col("object")).alias("object_key"))
        .agg(F.max("confidence").alias(x))
    )
    return side(left, "left_confidence").join(side(right, "right_confidence"), ["predicate", "object_key"])


ship(__name__)
