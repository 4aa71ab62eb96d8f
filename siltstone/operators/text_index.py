"""A stored index of documents: chunks, and posting blocks with bounds, brought up to date by changed documents only.

Rows lie in the buckets of a ``Store`` by document. The chunks of a bucket fall into ranges of at most ``RANGE``; a posting block holds what one term
has in one range: each chunk's counts in title, section and text, its length, and the largest counts and smallest length among them. These
bound every score of the block whatever the weights, the number of documents and their mean length are later, so a changed bucket
leaves the blocks of all others as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written
from ..shipping import ship
from ..sources.store import Store
from .chunking import chunk_rows
from .retrieval import K1, B, top_k

RANGE = 1024
RANGE_TOKENS = 1 << 20
PIECE_BYTES = 1 << 25
BLOCK = 512
FIELDS = ("title", "section", "text")


def as_chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, title, text, strategy) as chunks with the title of their document."""
    titles = docs.select("doc_id", "title")
    return chunk_rows(docs).join(titles, "doc_id").select("doc_id", "chunk_id", "title", "section", "text")


def as_they_are(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, title, section, text) as one chunk each."""
    return docs.select("doc_id", F.col("doc_id").alias("chunk_id"), "title", "section", "text")


def digest_of(docs: DataFrame) -> Column:
    """Hash of all columns of a document but its id; a null isn't an empty text."""
    return F.sha2(F.to_json(F.struct(*(c for c in sorted(docs.columns) if c != "doc_id")), {"ignoreNullFields": "true"}), 256)


def compared(store: Store, docs: DataFrame, last: dict) -> DataFrame:
    """(doc_id, digest, bucket, size, state) of each document that comes or is stored: new, changed, unchanged or gone; the size is the bytes that come."""
    size = sum((F.octet_length(T.text_or_empty(F.col(c).cast("string"))) for c in docs.columns if c != "doc_id"), F.lit(0))
    new = docs.select("doc_id", digest_of(docs).alias("digest"), size.cast("long").alias("size"))
    old = store.read("documents", last)
    if old is None:
        return new.select("doc_id", "digest", store.bucket_of(F.col("doc_id")).alias("bucket"), "size", F.lit("new").alias("state"))
    both = new.join(old.select("doc_id", F.col("digest").alias("stored")), "doc_id", "full")
    state = F.when(F.col("digest").isNull(), "gone").when(F.col("stored").isNull(), "new").when(F.col("digest") == F.col("stored"), "unchanged").otherwise("changed")
    return both.select("doc_id", F.coalesce("digest", "stored").alias("digest"), store.bucket_of(F.col("doc_id")).alias("bucket"), "size", state.alias("state"))


def _ranges(buckets: np.ndarray, lengths: np.ndarray, most: int, tokens: int) -> Iterator[tuple[int, int]]:
    """Spans of rows of one bucket with at most ``most`` rows and, beyond the first row, ``tokens`` tokens."""
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and (buckets[i] != buckets[at] or i - at == most or held + n > tokens):
            yield at, i
            at, held = i, 0
        held += n
    if len(lengths):
        yield at, len(lengths)


def _blocks(most: int, most_tokens: int):
    def of_range(rows: pa.RecordBatch) -> pa.RecordBatch:
        """A block for each term of some chunks of one bucket, in the order of terms."""
        ids, lists, n = rows.column("chunk_id"), rows.column("tokens"), rows.num_rows
        lengths = np.asarray(lists.value_lengths(), np.int64)
        words, row = lists.flatten().dictionary_encode(), np.repeat(np.arange(n), lengths)
        order = pc.sort_indices(words.dictionary)
        at = np.argsort(np.asarray(order))  # a word's place among all
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        field = sum((place >= np.asarray(rows.column(c))[row]).astype(np.int64) for c in ("section_at", "text_at"))
        pairs, which = np.unique(at[np.asarray(words.indices)] * n + row, return_inverse=True)
        counts = np.bincount(which * 3 + field, minlength=3 * len(pairs)).reshape(-1, 3).astype(np.int32)
        term, doc = pairs // n, pairs % n
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        columns = [ids.take(pa.array(doc)), *(pa.array(c) for c in counts.T), pa.array(lengths[doc].astype(np.int32))]
        postings = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)).astype(np.int32)), pa.StructArray.from_arrays(columns, ["chunk_id", *FIELDS, "length"]))
        largest = np.maximum.reduceat(counts, starts)
        number = np.full(len(starts), crc32(str(ids[0].as_py()).encode()) >> 1, np.int32)  # two ranges of one number are one range
        out = {"bucket": rows.column("bucket")[:1].take(pa.array(np.zeros(len(starts), np.int32))), "range": number, "term": words.dictionary.take(order.take(pa.array(term[starts]))), "postings": postings}
        out |= {f"most_{c}": x for c, x in zip(FIELDS, largest.T)} | {"shortest": np.minimum.reduceat(lengths[doc], starts).astype(np.int32)}
        out |= {"n": np.diff(starts, append=len(pairs)), "tokens": np.add.reduceat(counts.sum(axis=1, dtype=np.int64), starts)}
        return pa.RecordBatch.from_pydict({c: v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v)) for c, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _ranges(np.asarray(batch.column("bucket")), np.asarray(batch.column("tokens").value_lengths()), most, most_tokens):
                rows = batch.slice(a, b - a)
                if len(rows.column("tokens").flatten()):
                    yield of_range(rows)

    return run


def posting_blocks(chunks: DataFrame) -> DataFrame:
    """(bucket, range, term, postings, most_title, most_section, most_text, shortest, n, tokens) of chunks (bucket, chunk_id, title, section, text) with a token.

    A range is a run of at most ``RANGE`` chunks and, beyond one chunk, ``RANGE_TOKENS`` tokens of one bucket, as they lie in a task: nothing is moved, and what is held
    at a time is one range however large buckets are.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    tokens = chunks.select("bucket", "chunk_id", *(T.tokenize(T.text_or_empty(c)).alias(c) for c in FIELDS))
    rows = tokens.select("bucket", "chunk_id", F.size("title").alias("section_at"), (F.size("title") + F.size("section")).alias("text_at"), F.concat(*FIELDS).alias("tokens"))
    schema = f"bucket int, range int, term string, postings array<struct<chunk_id:{kind},title:int,section:int,text:int,length:int>>, "
    schema += "most_title int, most_section int, most_text int, shortest int, n long, tokens long"
    return rows.mapInArrow(_blocks(RANGE, RANGE_TOKENS), schema)


def update(store: Store, docs: DataFrame, to_chunks: Callable[[DataFrame], DataFrame] = as_chunks, prune: bool = True) -> DataFrame:
    """Bring the store up to date with ``docs``, unique by doc_id; returns (doc_id, state) of this run.

    Only documents whose digest is new are chunked, and only buckets that hold one of them, or one that is gone, are written again. Where
    nothing has changed nothing is written. Without ``prune`` documents that don't come stay. A document without chunks is stored too, so it
    isn't looked at again. The driver holds the numbers of the touched buckets.
    """
    last, version = store.begin()
    states = compared(store, docs, last)
    if not prune:
        states = states.where("state != 'gone'")
    states = written(states, "states")
    moved = states.where("state != 'unchanged'")
    sizes = states.groupBy("bucket").agg(F.count_if(F.col("state") != "unchanged").alias("moved"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).where("moved > 0").collect()
    touched = sorted(r["bucket"] for r in sizes)
    if not touched:
        return states.select("doc_id", "state")
    pieces = max(1, -(-max(r["bytes"] for r in sizes) // PIECE_BYTES))
    fresh = docs if not last["tables"].get("documents") else docs.join(moved.where("state != 'gone'").select("doc_id"), "doc_id", "left_semi")
    chunks = to_chunks(fresh).withColumn("bucket", store.bucket_of(F.col("doc_id")))
    records = moved.where("state != 'gone'").select("doc_id", "digest", "bucket")
    old_chunks, old_records = (store.read(name, last, touched) for name in ("chunks", "documents"))
    deal = lambda rows: store.deal(rows, F.col("doc_id"), pieces)
    chunks, records = deal(chunks), deal(records)
    if old_chunks is not None:
        marks = moved.select("doc_id", "bucket", F.lit(True).alias("moved"))
        gone = F.max("moved").over(Window.partitionBy("bucket", "piece", "doc_id"))  # where the rows are dealt to, so they move once
        stays = lambda rows: deal(rows.unionByName(marks, True)).withColumn("moved", gone).where("moved IS NULL").drop("moved")
        chunks, records = chunks.unionByName(stays(old_chunks)), records.unionByName(stays(old_records))
    chunks = store.stage("chunks", version, chunks.drop("piece"), ["chunk_id"], dealt=True)
    store.stage("documents", version, records.drop("piece"), ["doc_id"], dealt=True)
    blocks = store.stage("blocks", version, posting_blocks(chunks), [], dealt=True)
    tokens = blocks.groupBy("bucket").agg(F.sum("tokens").alias("tokens"))
    totals = chunks.groupBy("bucket").agg(F.count("*").alias("n")).join(tokens, "bucket", "left")
    store.stage("totals", version, totals.select("bucket", "n", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), ["n"])
    store.commit(last, version, touched)
    return states.select("doc_id", "state")


def _best_of_cell(k: int, weights: dict[str, float], mean: float):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        """(query_id, doc_id, score): the k best of a cell's chunks (term, postings) for each of its queries (query_id, term, idf), and ties."""
        coded = lambda c: pc.dictionary_encode(c.combine_chunks(), null_encoding="encode")
        lists = blocks["postings"].combine_chunks()
        held = lists.flatten()
        if not (len(held) and asked.num_rows):
            return pa.table({"query_id": asked["query_id"][:0], "doc_id": held.field("chunk_id")[:0], "score": pa.array([], pa.float64())})
        ids, queries = coded(pa.chunked_array([held.field("chunk_id")])), coded(asked["query_id"])
        words = pc.unique(blocks["term"])
        place = lambda c: np.asarray(pc.fill_null(pc.index_in(c, value_set=words), len(words)))  # noqa: E731  the last place is for words without a block
        term = np.repeat(place(blocks["term"]), np.asarray(lists.value_lengths()))
        by_term = np.argsort(term, kind="stable")
        n = np.bincount(term, minlength=len(words) + 1)
        each = n[word := place(asked["term"])]
        at = by_term[np.arange(each.sum()) + np.repeat((np.cumsum(n) - n)[word] - np.cumsum(each) + each, each)]  # the postings of each word that a query asks
        tf, length = sum((w * np.asarray(held.field(c), float) for c, w in weights.items()), 0.0)[at], np.asarray(held.field("length"))[at]
        part = np.repeat(np.asarray(asked["idf"]), each) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        shape = len(queries.dictionary), len(ids.dictionary)
        pair = np.repeat(np.asarray(queries.indices, np.int64), each) * shape[1] + np.asarray(ids.indices)[at]
        score, met = (np.bincount(pair, x, shape[0] * shape[1]).reshape(shape) for x in (part, None))
        score = np.where(met > 0, score, -np.inf)
        least = np.partition(score, -k, axis=1)[:, -k] if shape[1] > k else np.full(shape[0], -np.inf)
        ends = pc.min_max(ids.dictionary)
        edge = [x in (None, ends["min"].as_py(), ends["max"].as_py()) for x in ids.dictionary.to_pylist()]  # an id that comes again may do so in the next range
        q, d = np.nonzero((met > 0) & ((score >= least[:, None] - 2e-6) | np.array(edge)))
        return pa.table({"query_id": queries.dictionary.take(pa.array(q)), "doc_id": ids.dictionary.take(pa.array(d)), "score": score[q, d]})

    return run


def search(store: Store, queries: DataFrame, k: int, weights: dict[str, float] | None = None, terms_per_query: int = 12, first: int = 2) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best chunks for each query (query_id, text) by BM25 over weighted fields.

    A chunk's count of a term is the weighted sum over its fields, its length all their tokens. A range's bound for a query is the sum
    of its blocks' bounds. The ``first`` best ranges of each query are scored whole; their k-th score is a floor, and ranges whose bound
    lies below it are never opened. No text is read: only the blocks of the queries' terms, their bounds apart from their postings.

    A range meets a block of some ``BLOCK`` queries in a cell of its own. A chunk lies in one range, so its score is summed in its cell; only the
    k best of a cell for each query leave it, and what a task holds is one cell, however many chunks and queries there are.
    """
    weights = dict.fromkeys(FIELDS, 1.0) | (weights or {})
    commit = store.last_commit()
    n, tokens = store.read("totals", commit).agg(F.sum("n"), F.sum("tokens")).first()
    mean = (tokens or 0) / n if n else 1.0
    q = queries.select("query_id", F.explode(F.array_distinct(T.fts_terms(F.col("text"), terms_per_query))).alias("term"))
    held = written(store.read("blocks", commit).join(q.select("term").distinct(), "term", "left_semi"), "blocks")
    df = held.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = q.join(df, "term").select("query_id", "term", idf.alias("idf"))
    weighted = lambda of: sum((F.lit(float(w)) * of(c) for c, w in weights.items()), F.lit(0.0))
    part = lambda tf, length: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))
    most = part(weighted(lambda c: F.col(f"most_{c}")), F.col("shortest"))
    place = ["query_id", "bucket", "range"]
    bounds = terms.join(held.select("term", "bucket", "range", *(f"most_{c}" for c in FIELDS), "shortest"), "term").groupBy(*place).agg(F.sum(most).alias("bound"))
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "bucket", "range")
    bounds = written(bounds.withColumn("at", F.row_number().over(best)), "bounds")

    parts = -(-(n or 0) // RANGE) + (tokens or 0) // RANGE_TOKENS
    blocks = max(1, -(-queries.count() // BLOCK))
    tasks = max(1, -(-parts * blocks // 2))
    cell = ["bucket", "range", "block"]
    postings = held.select("bucket", "range", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", "postings")
    ids = dict(store.read("chunks", commit).dtypes)["chunk_id"]

    def scored(ranges: DataFrame) -> DataFrame:
        asked = ranges.join(terms, "query_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        left, right = (rows.repartition(tasks, *cell).groupBy(*cell) for rows in (postings, asked))
        best = left.cogroup(right).applyInArrow(_best_of_cell(k, weights, mean or 1.0), f"query_id {dict(terms.dtypes)['query_id']}, doc_id {ids}, score double")
        return best.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))

    sure = written(top_k(scored(bounds.where(F.col("at") <= first).select(*place)), k), "scores")
    floor = sure.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = open_ranges(bounds.where(F.col("at") > first), floor)
    return top_k(sure.drop("rank").unionByName(scored(rest.select(*place))), k)


def open_ranges(bounds: DataFrame, floor: DataFrame) -> DataFrame:
    """Ranges that may hold a hit: those whose bound reaches the floor, short of what scores are rounded by, and all where there is none."""
    return bounds.join(floor, "query_id", "left").where("floor IS NULL OR bound >= floor - 1e-6")


ship(__name__)
