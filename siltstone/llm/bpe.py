"""BPE encoding and decoding with a distinct-word table.

1. Spark splits the texts into words by the tokenizer's pattern. Each distinct word is kept once, with the
   list of the input splits it occurs in (8 bytes for each split, however often the word occurs there).
2. Each distinct word is encoded once; its ids go to a table sorted by input split, whose splits are dealt to at most as
   many folders as Spark has shuffle partitions.
3. A second scan splits the texts again; every task reads the row groups of its own splits only and joins the ids
   to the words by position, in Arrow. Neither texts nor word occurrences are shuffled.
4. Decoding joins the ids to the vocabulary's pieces, by position too, and joins each text's bytes.

Results do not depend on the table: a word that it lacks (splits cut anew between the scans) is encoded in place.
``<|endoftext|>`` in a text is the special token, as in the tokenizers library. Java's and the library's letter
and number classes differ only in code points that the Java version does not know yet.

Defined cases: null text is empty and has no tokens; rows with one doc_id or a null one are rows of their own;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, columns, scratch, ship, written

# Fixed value: the pattern that splits text before the merges; (?U) gives \s its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def split_words(text: Column, special: str = "<|endoftext|>") -> Column:
    """The words of a text in order; they join to the text again."""
    text = F.coalesce(text, F.lit(""))
    cut = lambda t: F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    quoted = "".join("\\" + c if not c.isalnum() else c for c in special)
    parts = F.split(text, f"(?={quoted})|(?<={quoted})")
    marked = F.flatten(F.transform(parts, lambda p: F.when(p == special, F.array(p)).otherwise(cut(p))))
    return F.when(F.contains(text, F.lit(special)), marked).otherwise(cut(text))


def load_tokenizer(spec: str):
    """The tokenizer for single words: no pattern of its own, no truncation, padding or threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok


def encode_words(tok, words: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, np.uint32) for e in tok.encode_batch(words, add_special_tokens=False)]


def byte_pieces(spec: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    # Printable Latin-1 stands for itself; the other bytes follow from code point 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    doc = json.loads(spec)
    vocab = doc["model"]["vocab"] | {t["content"]: t["id"] for t in doc["added_tokens"]}
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        pieces[i] = bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode()
    return pieces


def _encode(spec: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = load_tokenizer(spec)
        for pdf in batches:
            words = pdf["word"].tolist()
            ids = []
            for at in range(0, len(words), 1000):
                ids += [x.tobytes() for x in encode_words(tok, words[at : at + 1000])]
            yield pd.DataFrame({"word": words, "ids": ids, "parts": pdf["parts"]})

    return run


def word_table(spec: str, docs: DataFrame, path: str, folders: int) -> None:
    """Write the distinct words with their ids to ``path``, by folder and input split, in row groups of some megabytes."""
    found = docs.select("part", F.explode(F.array_distinct(split_words(F.col("text")))).alias("word"))
    (
        found.groupBy("word")
        .agg(F.collect_set("part").alias("parts"))
        .mapInPandas(_encode(spec), "word string, ids binary, parts array<bigint>")
        .select(F.explode("parts").alias("part"), "word", "ids")
        .withColumn("folder", F.pmod("part", F.lit(folders)))
        .repartition("folder", F.pmod(F.xxhash64("word"), F.lit(4)))  # a folder's words go to up to four tasks
        .sortWithinPartitions("folder", "part")
        .write.partitionBy("folder")
        .option("compression", "zstd")
        .option("parquet.block.size", 1 << 22)
        .parquet(path)
    )


class _Lookup:
    """Ids of words by position, from the table of one split at a time."""

    def __init__(self, spec: str, path: str, folders: int) -> None:
        self.spec, self.path, self.folders, self.part, self.tok = spec, path, folders, None, None

    def load(self, part: int) -> None:
        if part == self.part:
            return
        fs, root = pafs.FileSystem.from_uri(self.path)
        folder = f"{root}/folder={part % self.folders}"
        if fs.get_file_info(folder).type == pafs.FileType.NotFound:
            table = pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.binary())})
        else:
            table = ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["word", "ids"], filter=ds.field("part") == part)
        self.part, self.words = part, table["word"].combine_chunks()
        ids = table["ids"].combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.binary())
        if isinstance(self.words, pa.ChunkedArray):
            self.words = pa.concat_arrays(self.words.chunks) if self.words.num_chunks else pa.array([], pa.string())
        self.ids = ids

    def __call__(self, part: int, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        self.load(part)
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            self.tok = self.tok or load_tokenizer(self.spec)
            new = pc.unique(words.filter(pc.is_null(at)))
            ids = [x.tobytes() for x in encode_words(self.tok, new.to_pylist())]
            self.words = pa.concat_arrays([self.words, new.cast(self.words.type)])
            self.ids = pa.concat_arrays([self.ids, pa.array(ids, self.ids.type)])
            at = pc.index_in(words, value_set=self.words)
        taken = self.ids.take(at)
        sizes = np.diff(np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4))
        return sizes // 4, np.frombuffer(taken.buffers()[2], "<u4", int(sizes.sum()) // 4)


def _round_trip(spec: str, path: str, folders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(spec, path, folders)
        pieces = pa.array(byte_pieces(spec), pa.binary())
        for batch in batches:
            sizes = pc.list_value_length(batch.column("words")).to_numpy()
            for start, stop in _runs(batch.column("part").to_numpy(), sizes):
                rows = batch.slice(start, stop - start)
                part = rows.column("part")[0].as_py()
                lists = rows.column("words")
                sizes, ids = lookup(part, lists.flatten())
                ends = np.concatenate([[0], np.cumsum(sizes)])
                words = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
                cuts = ends[words]
                joined = pieces.take(pa.array(ids))
                at = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, joined.offset * 4)
                raw, text = memoryview(ids).cast("B"), memoryview(joined.buffers()[2] or b"")
                sha, back = [], []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    sha.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                    plain = bytes(text[int(at[a]) : int(at[b])])
                    back.append(hashlib.sha256(plain.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(cuts), pa.int64()), pa.array(sha), pa.array(back)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                del rows, lists, sizes, ids, joined, at, raw, text
            pa.default_memory_pool().release_unused()

    return run


def _runs(parts: np.ndarray, sizes: np.ndarray, most: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of rows of one split with at most ``most`` words, or one row with more."""
    out, start, words = [], 0, 0
    for row in range(len(parts)):
        if row > start and (parts[row] != parts[start] or words + sizes[row] > most):
            out.append((start, row))
            start, words = row, 0
        words += int(sizes[row])
    return [*out, (start, len(parts))] if len(parts) else []


def with_splits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the input split of each row; rows that come from no file, or from several inputs, are written to one first."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    inputs = docs._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    if inputs != 1 or any(r[0] == "" for r in docs.select(F.input_file_name()).head(1)):
        rows = written(rows, "rows")
    return rows.withColumn("part", F.xxhash64(F.input_file_name(), F.input_file_block_start()))


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    arrow_rows(docs.sparkSession, 1000)
    rows = with_splits(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    path = scratch(docs.sparkSession, "words")
    folders = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    word_table(spec, rows, path, folders)
    return rows.select("doc_id", "part", split_words(F.col("text")).alias("words")).mapInArrow(
        _round_trip(spec, path, folders), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


ship(__name__)
