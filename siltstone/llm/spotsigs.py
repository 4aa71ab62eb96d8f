"""Document fingerprints by spot signatures, with built-in expressions only.

A spot signature is a run of common words (anchors) with the next two content words that follow it.
A document's fingerprint is the set of its signatures, kept as sorted 32-bit hashes. Two fingerprints
are compared by Jaccard; the ratio of their sizes bounds it, so sets whose lengths differ too much are
never compared: sets live in length partitions of which only the same or the next one can match. The contract's query
wants the likeness of given pairs (a text and its edited form, a text and the next), however small, so it prunes nothing unless it
is given a ``floor``; ``near_pairs`` finds the pairs of all sets and prunes by its threshold.

Words that no spot begins with (stretches without anchors, other scripts) are signed in pairs with the word that
follows. Which signatures a place gets depends on the few words around it, never on the rest of the text, so texts
that share a passage share its signatures. An anchor counts as a plain word where ``MAX_RUN`` anchors follow it at
once or where fewer than two content words follow it in the text. A text of one word has one signature, an empty
text none.

Defined cases: null text counts as empty; two fingerprints without signatures are alike (1.0), one
without and one with are not (0.0); rows with one doc_id are ordered by text; a document with null
doc_id comes in a block of its own, whose last row is followed by nothing (an empty text).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns

# Common function words of English, German, French and Spanish.
ANCHORS = tuple(
    """the of and to a in that is was for on with as by at this from be are it or an
    der die das und in den von zu mit ist auf für im ein eine nicht als auch an dem
    le la les de des et en un une du que qui dans pour par sur est au avec ce
    el los las y del se por con para una su es al lo como más""".split()
)
ANCHORS = tuple(sorted(set(ANCHORS)))
MAX_RUN = 4
# The mark of an anchor that begins no spot: a full run of anchors follows it, or at most one content word.
PLAIN = r"\|(?=(?:[^ |]++\|){%d}|(?:[^ |]++\|)*+(?:[^ |]++ (?:[^ |]++\|)*+)?\z)" % MAX_RUN


def _hash32(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 32)


def with_signatures(df: DataFrame, text_col: str, out: str, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """Add ``out``: the sorted distinct signature hashes of ``text_col``."""
    words, chain = f"_{out}_w", f"_{out}_c"
    mark = lambda w: F.concat(w, F.when(w.isin(*anchors), F.lit("|")).otherwise(F.lit(" ")))
    part = lambda b, k: F.substring_index(b, "|", k)
    signed = lambda a, b: F.when(F.contains(a, F.lit("|")), _hash32(a, part(b, -1))).when(b != "", _hash32(a, part(b, 1)))
    found = F.filter(F.zip_with(chain, F.slice(chain, F.lit(2), F.size(chain)), signed), lambda x: x.isNotNull())
    return (
        df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
        .withColumn(chain, F.split(F.regexp_replace(F.array_join(F.transform(words, mark), ""), PLAIN, " "), " "))
        .withColumn(
            out,
            F.when(F.size(words) == 1, F.array(_hash32(F.element_at(words, 1)))).otherwise(F.sort_array(F.array_distinct(found))),
        )
        .drop(words, chain)
    )


def pruned_jaccard(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard of two signature sets, 0 where it is below ``floor``; length partitions and sizes decide first where they can."""
    both = F.size(F.array_intersect(a, b))
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    ratio = F.when(high == 0, F.lit(1.0)).when(low == 0, F.lit(0.0))
    exact = both / (F.size(a) + F.size(b) - both)
    if floor <= 0:
        return ratio.otherwise(exact)
    apart = length_partition(high, floor) - length_partition(low, floor)
    return ratio.when((apart > 1) | (low < F.lit(floor) * high) | (exact < floor), F.lit(0.0)).otherwise(exact)


def length_partition(size: Column, threshold: float) -> Column:
    """Number of a set's length partition: sets with Jaccard >= threshold are at most one apart."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1.0 / threshold))).cast("int")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """Pairs of class representatives (a < b, jaccard) with Jaccard >= threshold.

    A class is a set of documents with one fingerprint; its representative is the smallest id (join the
    fingerprints for membership). Candidates share one of their rarest signatures: with n signatures, in one order of all
    signatures by the number of sets that hold them, the first n - ceil(threshold * n) + 1 must hold one in common.
    """
    sets = (
        with_signatures(columns(docs, doc_id=id_col, text=text_col), "text", "sigs")
        .where(F.size("sigs") > 0)
        .groupBy("sigs")
        .agg(F.min("doc_id").alias("id"))
        .withColumn("n", F.size("sigs"))
        .withColumn("part", length_partition(F.col("n"), threshold))
    )
    each = sets.select("id", "n", "part", F.explode("sigs").alias("sig"))
    held = each.groupBy("sig").agg(F.count("*").alias("held"))
    rare = F.sort_array(F.collect_list(F.struct("held", "sig")))
    prefix = F.slice("rare", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(threshold)).cast("int") + 1)
    ranked = each.join(held, "sig").groupBy("id", "n", "part").agg(rare.alias("rare"))
    own = ranked.select("id", "n", "part", F.explode(prefix).alias("s")).select("id", "n", "part", "s.sig")
    left = own.select(F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    right = own.select(F.col("id").alias("b"), F.col("n").alias("nb"), "part", "sig")
    fits = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")
    once = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["part", "sig"]).where(fits & once).select("a", "b").distinct()
    body = sets.select("id", "sigs")
    return (
        pairs.join(body.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a")
        .join(body.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
        .withColumn("jaccard", pruned_jaccard(F.col("sa"), F.col("sb"), threshold))
        .where(F.col("jaccard") >= threshold)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    )


def fingerprint(sigs: Column) -> Column:
    """A signature set as text: eight hex digits for each signature, ascending."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def _constant(values: list, kind: str) -> Column:
    """A constant array as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below ``doc_id``, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    table, n = _constant(bounds, "bigint"), len(bounds)
    # try_element_at: a step beyond the end finds null, which takes no step
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.try_element_at(table, at + step) <= doc_id), at + step).otherwise(at),
    )


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, signatures, and those of the next document by ascending id (after the last: the first).

    Ids are cut at quantiles (ids of the table, a few for each shuffle partition) and each text moves once, to
    its block; the first document of a block is also sent to the block before, so no block needs another.
    """
    spark = docs.sparkSession
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("doc_id", _constant([i / n for i in range(1, n)], "double"), 10 * n)
    first, cuts = rows.agg(F.min("doc_id"), cuts).first()
    bounds = sorted({c for c in cuts or [] if c > first})
    own = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_bucket(F.col("doc_id"), bounds))
    head = (F.col("own") > 0) & (F.try_element_at(_constant(bounds, "bigint"), F.nullif(F.col("own"), F.lit(0))) == F.col("doc_id"))
    heads = F.when(head, F.col("own") - 1).when(F.col("doc_id") == first, F.lit(len(bounds)))
    block = Window.partitionBy("block").orderBy("guest", "doc_id", "text")
    sent = (
        rows.withColumn("own", own)
        .withColumn("at", F.explode(F.array_compact(F.array(
            F.struct(F.col("own").alias("block"), F.lit(False).alias("guest")),
            F.when(heads.isNotNull(), F.struct(heads.alias("block"), F.lit(True).alias("guest"))),
        ))))
        .select("doc_id", "text", "at.block", "at.guest")
        .repartition("block")
    )
    return (
        with_signatures(sent, "text", "sigs")
        .withColumns({"next_text": F.lead("text").over(block), "next_sigs": F.lead("sigs").over(block)})
        .where(~F.col("guest"))
        .drop("block", "guest")
        .withColumn("next_text", F.coalesce("next_text", F.lit("")))
        .withColumn("next_sigs", F.coalesce("next_sigs", F.array().cast("array<bigint>")))
    )


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor: float = 0.0) -> DataFrame:
    """Fingerprints of each text and of the text whose last quarter comes from the next document; likeness of at least ``floor``."""
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = with_next_text(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    return with_signatures(rows, "edited", "edited_sigs").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("sigs"), F.col("edited_sigs"), floor).alias("near_edited"),
        pruned_jaccard(F.col("sigs"), F.col("next_sigs"), floor).alias("near_next"),
    )
