"""Token sequences in training order: fixed-stride binary shards in an order drawn by a keyed permutation.

1. Texts become token ids, each followed by the end mark, in sequences of ``length`` ids; the last of a text is
   padded. Every task numbers its sequences; the tasks' counts (one number each) give every sequence its index.
   A row holds a whole text's ids; Spark cuts it into sequences only where they are sent to their shards.
2. A keyed Feistel network with cycle-walking permutes the indexes 0..n-1: a sequence's slot.
3. Each range of ``per_shard`` slots is a partition, known without sampling, and writes a shard of records of
   one stride. Slot s starts at byte (s mod per_shard) * stride of shard s div per_shard, so readers can go on
   at any slot, sequentially.

A shard is written under a name of the task attempt and moved into place, and its content depends on the
data's splits, key and sizes alone, so a repeated task does no harm; other splits of one table give another order. Tokenised sequences are kept by Spark (memory, then
disk) between the count and the write; lost parts are made again from the texts.

A record: doc_id (int64), sequence number (uint32), ids used (uint32), then ``length`` ids (uint16 or uint32).

Defined cases: null text is empty: a sequence with the end mark only; a null doc_id is written as the least int64
and read back as null; rows with one doc_id are rows of their own; an empty table gives no shards.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, columns, from_files, ship, written

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD = np.dtype([("doc_id", "<i8"), ("seq_no", "<u4"), ("used", "<u4")])
NO_ID = -(2**63)
MOST_SHARDS = 20_000
TEXT = "part int, pos long, doc_id long, ids binary"
SHARD = "shard long, first_slot long, records long, file string"
RECORD = "slot long, shard long, doc_id long, seq_no int, n_tokens int, ids_sha256 string"


def _round(x: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    h = (x ^ np.uint64((key + 0x9E3779B97F4A7C15 * (turn + 1)) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(32))) & mask


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1: Feistel rounds over an even number of bits, repeated while outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for turn in range(rounds):
            left, right = right, left ^ _round(right, key, turn, mask)
        return left << shift | right

    out = network(np.asarray(index, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def _tokenise(ranks: bytes, length: int, width: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, ranks.splitlines())}
        encode = tiktoken.Encoding("table", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_to_numpy
        kind = np.dtype(width)
        mark, part, pos = np.array([len(table)], kind).tobytes(), TaskContext.get().partitionId(), 0
        for pdf in batches:
            ids = [encode(t, disallowed_special=()).astype(kind).tobytes() + mark for t in pdf["text"]]
            n = np.array([-(-len(x) // (length * kind.itemsize)) for x in ids], np.int64)
            starts = pos + np.cumsum(n) - n
            pos += int(n.sum())
            yield pd.DataFrame({"part": part, "pos": starts, "doc_id": pdf["doc_id"], "ids": ids})

    return run


def _slots(n: int, key: int):
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), n, key))

    return F.pandas_udf(slot, "long")


def _write(out_dir: str, stride: int, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        attempt = TaskContext.get().taskAttemptId()
        shard, out, first, count = None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            name = f"shard-{shard:08d}.bin"
            fs.move(f"{root}/_{attempt}-{shard}", f"{root}/{name}")
            row = {"shard": shard, "first_slot": first, "records": count, "file": name}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("records", pa.int64()), ("file", pa.string())]))

        for batch in batches:
            slots = batch.column("slot").to_numpy()
            head = np.zeros(len(slots), HEAD)
            head["doc_id"] = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
            head["seq_no"], head["used"] = batch.column("seq_no").to_numpy(), batch.column("used").to_numpy()
            ids = batch.column("ids")  # all padded to one length, so their bytes are one block
            at = np.frombuffer(ids.buffers()[1], np.int32, 1, ids.offset * 4)[0]
            body = np.frombuffer(ids.buffers()[2], np.uint8, len(slots) * stride, at).reshape(-1, stride)
            rows = np.concatenate([head.view(np.uint8).reshape(-1, HEAD.itemsize), body], axis=1)
            cuts = [0, *(np.nonzero(np.diff(slots // per_shard))[0] + 1).tolist(), len(slots)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if slots[lo] // per_shard != shard:
                    if out is not None:
                        yield close()
                    shard, first, count = int(slots[lo] // per_shard), int(slots[lo]), 0
                    out = fs.open_output_stream(f"{root}/_{attempt}-{shard}", compression=None)
                out.write(rows[lo:hi].tobytes())
                count += hi - lo
        if out is not None:
            yield close()

    return run


def materialise(
    docs: DataFrame,
    out_dir: str,
    ranks_path: str,
    key: int = 0,
    length: int = 256,
    per_shard: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the shards below ``out_dir``; return their manifest (shard, first_slot, records, file).

    A shard holds ``per_shard`` sequences: 32,768, or as many more as leave ``MOST_SHARDS`` shards at most, as each is one task's. Rows that
    come from no file are written to one first: places follow from the order of rows in their splits, which a lost executor's task must find again.
    """
    spark = docs.sparkSession
    arrow_rows(spark, 1000)
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    width = "<u2" if len(ranks.splitlines()) < 1 << 16 else "<u4"
    item = np.dtype(width).itemsize
    stride = length * item
    rows = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not from_files(docs):
        rows = written(rows, "texts")
    made = rows.mapInPandas(_tokenise(ranks, length, width), TEXT).persist(StorageLevel.MEMORY_AND_DISK)
    pieces = F.ceil(F.octet_length("ids") / stride)
    try:
        counts = sorted((r[0], r[1]) for r in made.groupBy("part").agg(F.sum(pieces)).collect())  # one row for each task
        starts, n = [], 0
        for part, size in counts:
            starts.append((part, n))
            n += size
        per_shard = per_shard or max(1 << 15, -(-n // MOST_SHARDS))
        offsets = spark.createDataFrame(starts or [(0, 0)], "part int, start long")
        cut = lambda k: F.substring(F.col("ids"), (k * stride + 1).cast("int"), F.lit(stride))
        sequences = made.join(F.broadcast(offsets), "part").select(
            (F.col("start") + F.col("pos")).alias("base"),
            "doc_id",
            F.posexplode(F.transform(F.sequence(F.lit(0), (pieces - 1).cast("int")), cut)).alias("k", "piece"),
        )
        placed = sequences.select(
            _slots(max(n, 1), key)(F.col("base") + F.col("k")).alias("slot"), "doc_id", F.col("k").alias("seq_no"),
            (F.octet_length("piece") / item).cast("int").alias("used"), F.rpad("piece", F.lit(stride), F.lit(b"\0")).alias("ids"),
        )
        fs, root = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(root, recursive=True)
        (
            placed.repartitionById(max(1, -(-n // per_shard)), F.floor(F.col("slot") / per_shard).cast("int"))
            .sortWithinPartitions("slot")
            .mapInArrow(_write(out_dir, stride, per_shard), SHARD)
            .write.parquet(f"{out_dir}/manifest")
        )
    finally:
        made.unpersist()
    return spark.read.schema(SHARD).parquet(f"{out_dir}/manifest")


def _read(out_dir: str, length: int, width: str, from_slot: int, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        kind = np.dtype([("head", HEAD), ("ids", width, (length,))])
        for pdf in batches:
            for shard, first, records, name in zip(pdf["shard"], pdf["first_slot"], pdf["records"], pdf["file"]):
                skip = max(0, from_slot - first)
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(skip * kind.itemsize)
                    for at in range(skip, records, chunk):
                        block = np.frombuffer(f.read(min(chunk, records - at) * kind.itemsize), kind)
                        ids = [hashlib.sha256(r["ids"][: r["head"]["used"]].tobytes()).hexdigest() for r in block]
                        doc = pd.Series(block["head"]["doc_id"]).astype("Int64")
                        yield pd.DataFrame(
                            {"slot": first + at + np.arange(len(block)), "shard": shard, "doc_id": doc.mask(doc == NO_ID),
                             "seq_no": block["head"]["seq_no"].astype(np.int32), "n_tokens": block["head"]["used"].astype(np.int32), "ids_sha256": ids}
                        )

    return run


def read_sequences(
    manifest: DataFrame, out_dir: str, length: int = 256, width: str = "<u2", from_slot: int = 0, chunk: int = 4096, per_task: int = 2
) -> DataFrame:
    """The records from ``from_slot`` on: slot, shard, doc_id, seq_no, n_tokens, ids_sha256; each shard in sequence.

    A task reads ``per_task`` neighbouring shards; a manifest row is too small for Spark to tell what its shard weighs.
    """
    wanted = manifest.where(F.col("first_slot") + F.col("records") > from_slot)
    low, high = wanted.agg(F.min("shard"), F.max("shard")).first()
    tasks = 1 if low is None else (high - low) // per_task + 1
    group = F.floor((F.col("shard") - F.lit(low or 0)) / per_task).cast("int")
    return wanted.repartitionById(tasks, group).sortWithinPartitions("shard").mapInPandas(_read(out_dir, length, width, from_slot, chunk), RECORD)


def shuffle_order(spark: SparkSession, n: int, key: int) -> DataFrame:
    """(index, slot) of the permutation of n sequences."""
    return spark.range(n).select(F.col("id").alias("index"), _slots(max(n, 1), key)("id").alias("slot"))


ship(__name__)
