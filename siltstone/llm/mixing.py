"""Mixing sources to target weights: capped water-filling, then seeded repetitions of whole documents.

Targets: the budget is shared by weight; a source whose share exceeds ``max_epochs`` times its size is
clamped there and its excess goes to the others by weight, until no share is above its clamp.

Repetitions: a source with target/size = 1.4 takes each document once and 40 % of the words once more.
Documents of a source fall into cells of (size class, seeded hash bucket of id and text, so that null and
repeated ids spread). A source has at most
``size classes x buckets`` cells however many documents it has, so one small group per source decides
which cells are repeated: large classes first, a cell being taken when it is at most twice the words
still owed. Small cells come last and close the gap, so the words taken end near the target.

Defined cases: null text has size 0; null is a source of its own, last; sources of size 0 have target 0;
an empty table gives no rows; the same seed gives the same mix whatever the partitioning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, count_words, ship, written

BUCKETS = 512


def water_fill(sizes: list[int], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Targets by weight, none above ``max_epochs`` times its size, excess reshared until feasible; of a list in memory."""
    target = [0.0] * len(sizes)
    open_ = {i for i, s in enumerate(sizes) if s > 0}
    left = float(budget)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > max_epochs * sizes[i]}
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = float(max_epochs * sizes[i])
            left -= target[i]
        open_ -= full
    return target


def water_filled(sources: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) of sources (source, source_size), weighted in code point order, null last.

    Sources are filled up in order of their clamp for a unit of weight. With those before it full, the rest of the budget
    for a unit of weight is the level at a source; the first whose clamp lies at or above its level, and all after it, stay below
    their clamps at that level. The windows run over one row for each source and spill where these are many.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_clamp = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = by_clamp.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumns({"at": F.row_number().over(by_clamp), "level": F.when(F.col("source_size") > 0, left / open_weight)})
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("at", "level"))).over(everything)
    below = F.col("first").isNotNull() & (F.col("at") >= F.col("first.at"))
    return rows.withColumn("first", first).select(
        "source", "source_size", F.when(below, F.col("first.level") * F.col("weight")).otherwise(F.col("cap")).alias("target")
    )


def _cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which cells of one source are taken once more."""
    pdf = pdf.sort_values(["size_class", "bucket"], ascending=[False, True])
    whole = int(pdf["target"].iloc[0] // max(pdf["source_size"].iloc[0], 1))
    owed = pdf["target"].iloc[0] - whole * pdf["source_size"].iloc[0]
    share, due, extra = owed / max(pdf["source_size"].iloc[0], 1), 0.0, []
    for words in pdf["words"]:
        due += share * words
        take = due > 0 and words <= 2 * due
        extra.append(int(take))
        due -= words * take
    return pdf.assign(whole=whole, extra=extra)[["source", "size_class", "bucket", "source_size", "target", "whole", "extra"]]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, the repetitions ``times``, source and ``row_col``.

    ``weights`` go to the sources in code point order, repeating, null last. Nothing is gathered.
    """
    rows = columns(docs, doc_id=id_col, text=text_col, source=source_col, **({"row": row_col} if row_col else {})).select(
        "doc_id", *(["row"] if row_col else []), F.col("source").cast("string").alias("source"), count_words(F.col("text")).cast("long").alias("size"),
        F.xxhash64("doc_id", "text", F.lit(seed)).alias("at"),
    )
    rows = rows.withColumns(
        {
            "size_class": F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int"),
            "bucket": F.pmod("at", F.lit(BUCKETS)).cast("int"),
        }
    )
    cells = written(rows.groupBy("source", "size_class", "bucket").agg(F.sum("size").alias("words")), "cells")
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = written(water_filled(sources, weights, budget, max_epochs), "targets")
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    decided = (
        cells.join(plan, same(cells, plan, "source"))
        .select(cells["source"], "size_class", "bucket", "words", "source_size", "target")
        .groupBy("source")
        .applyInPandas(
            _cells,
            "source string, size_class int, bucket int, source_size long, target double, whole int, extra int",
        )
    )
    return rows.join(decided, same(rows, decided, "source", "size_class", "bucket")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long").alias("taken"),
        (F.col("whole") + F.col("extra")).alias("times"),
        rows["source"],
        *([F.col("row").alias(row_col)] if row_col else []),
    )


ship(__name__)
