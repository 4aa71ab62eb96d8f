"""Hard negatives by exact search in k-means inverted lists.

1. Vectors become integers, floor(scale * component). Rows that agree in vector and label become one, with their smallest ids:
   no more are ever needed, as equal rows have equal scores and lower ids come first. A third of all rows may be one vector.
2. Centroids are fitted on at most ``FIT_ROWS`` of the distinct rows (those of the smallest hashes). Every distinct row goes to the
   list of its nearest centroid; lists are written to the shared folder, a list's files by several tasks. Of each list its
   centroid and radius, the largest distance of a row from the centroid, are kept.
3. Anchors are searched in blocks of neighbours. By the Cauchy-Schwarz inequality no row of a list scores more than
   <anchor, centroid> + |anchor| * radius, nor less than the same with a minus. A block reads lists by descending bound, skips
   those below the anchor's k-th score or outside its window, and stops when the bounds of all that are left fall strictly below
   the k-th scores. It does so for the positives first, whose scores give the windows of the negatives.
4. The results of a distinct anchor vector go to all its anchors; those of hot vectors (a thousandth of the anchors) are
   broadcast, at most a thousand.

Nothing is approximate: bounds have slack for rounding, ties with the k-th score are kept, and scores are exact (doubles where all
sums stay below 2^53, else the wider ``longdouble``). What grows: only the lists and results, both on disk. The driver holds
``FIT_ROWS`` vectors and at most ``MOST_LISTS`` centroids; a task a block of ``BLOCK`` anchors, ``LIST_ROWS`` rows of a list and
``HELD`` rows that were read before.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; rows that agree in id,
vector and label count once, otherwise rows with one id are rows of their own; shorter vectors are padded with zeros; an anchor
isn't its own positive, other rows with its vector may be; scores must fit 64 bits; an empty table gives no rows; columns that are not
named are not looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import columns, join_sized, scratch, ship, written

FIT_ROWS, MOST_LISTS, ROUNDS = 8192, 1024, 8
BLOCK, LIST_ROWS, HELD = 256, 2048, 40_000
SALTS = 16


def integers(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label, q and a key of (label, q), of the rows that take part."""
    named = columns(rows, vec_id=id_col, label=label_col, vec=vec_col).where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    q = F.transform("vec", lambda x: F.floor(x.cast("double") * scale))
    found = named.where(~bad).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), q.alias("q"))
    return found.withColumn("key", F.unhex(F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("q").cast("array<string>")), 256)))


def collapsed(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each key with its ``keep`` smallest ids; hot keys meet in salted groups first."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    once = rows.distinct().withColumn("salt", salt)
    some = once.withColumn("rank", F.row_number().over(Window.partitionBy("key", "salt").orderBy("vec_id"))).where(F.col("rank") <= keep)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("rank") <= keep)
    return best.groupBy("key").agg(F.first("label").alias("label"), F.first("q").alias("q"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(vectors: list, width: int, kind: type = np.float64) -> np.ndarray:
    """The vectors as rows, padded with zeros."""
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all rows from all centers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Centers of ``k`` clusters after a fixed number of rounds; empty clusters keep their center."""
    centers = x[:k].copy()
    for _ in range(ROUNDS):
        near = distances(x, centers).argmin(1)
        for c in range(k):
            if (own := near == c).any():
                centers[c] = x[own].mean(0)
    return centers


def _assign(centers: np.ndarray, lists: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = matrix(pdf["q"].tolist(), centers.shape[1])
            near = distances(x, centers).argmin(1) if len(x) else np.zeros(0, np.int64)
            out = pdf.assign(list=near.astype(np.int64))
            yield out.assign(far=np.sqrt(((x - centers[near]) ** 2).sum(1))) if lists else out

    return run


class Index:
    """Centroids, radii and the files of the lists, by their numbers; ``exact`` is the number type in which all scores are exact."""

    def __init__(self, path: str, numbers: np.ndarray, centers: np.ndarray, radii: np.ndarray, exact: type) -> None:
        self.path, self.numbers, self.centers, self.radii, self.exact = path, numbers, centers, radii, exact
        self.held: OrderedDict | None = None

    def read(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(vectors, labels, keys, ids) of a list, ``LIST_ROWS`` rows at a time; short lists are kept for a while."""
        if self.held is None:
            self.held, self.rows = OrderedDict(), 0
        if c in self.held:
            self.held.move_to_end(c)
            yield from self.held[c]
            return
        fs, root = pafs.FileSystem.from_uri(self.path)
        data = ds.dataset(f"{root}/list={self.numbers[c]}", filesystem=fs, format="parquet")
        kept, rows = [], 0
        for batch in data.to_batches(batch_size=LIST_ROWS, columns=["q", "label", "key", "ids"], batch_readahead=1, fragment_readahead=1):
            if not len(batch):
                continue
            x = matrix(batch.column("q").to_numpy(zero_copy_only=False).tolist(), self.centers.shape[1], self.exact)
            ids = np.empty(len(batch), object)
            ids[:] = batch.column("ids").to_pylist()
            part = (x, batch.column("label").to_numpy(), np.array(batch.column("key").to_pylist(), object), ids)
            rows += len(batch)
            if rows <= HELD // 4:
                kept.append(part)
            yield part
        if rows <= HELD // 4:
            self.held[c] = kept
            self.rows += rows
            while self.rows > HELD:
                _, old = self.held.popitem(last=False)
                self.rows -= sum(len(p[1]) for p in old)


def best(index: Index, q: np.ndarray, row: np.ndarray, label: np.ndarray, same: bool, least: np.ndarray, most: np.ndarray, k: int):
    """For each slot the ``k`` best (score, id, key) of rows with its label (``same``) or another, scores between ``least`` and ``most``.

    ``row`` says which anchor vector of ``q`` a slot belongs to. Returns slots, scores, ids and keys, by slot and rank.
    """
    size = np.sqrt((q * q).sum(1).astype(np.float64))[:, None] * index.radii
    middle = q.astype(np.float64) @ index.centers.T
    slack = 1e-6 + 1e-9 * (np.abs(middle) + size)
    above, below = (middle + size + slack)[row], (middle - size - slack)[row]
    order = np.argsort(-above.max(0, initial=-np.inf), kind="stable")
    ahead = np.maximum.accumulate(above[:, order[::-1]], axis=1)[:, ::-1]  # the best bound of this list and all later ones
    kth = np.full(len(row), -np.inf, index.exact)
    slot, score, ids, keys = np.zeros(0, np.int64), np.zeros(0, index.exact), np.zeros(0, np.int64), np.zeros(0, object)
    for place, c in enumerate(order):
        if (ahead[:, place] < kth).all():
            break
        seen = np.flatnonzero((above[:, c] >= np.maximum(kth, least)) & (below[:, c] <= most))
        if not len(seen):
            continue
        for x, labels, own, listed in index.read(int(c)):
            s = (q @ x.T)[row[seen]]
            fits = ((labels == label[seen, None]) == same) & (s >= np.maximum(kth, least)[seen, None]) & (s <= most[seen, None])
            if len(labels) > k:
                cut = np.partition(np.where(fits, s, -np.inf), len(labels) - k, axis=1)[:, len(labels) - k]
                fits &= s >= cut[:, None]
            at, item = np.nonzero(fits)
            if not len(at):
                continue
            times = np.array([len(i) for i in listed[item]])
            new = np.concatenate([listed[i] for i in item]).astype(np.int64)
            slot, score = np.append(slot, np.repeat(seen[at], times)), np.append(score, np.repeat(s[at, item], times))
            ids, keys = np.append(ids, new), np.append(keys, np.repeat(own[item], times))
            by = np.lexsort((ids, -score, slot))
            slot, score, ids, keys = slot[by], score[by], ids[by], keys[by]
            rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
            top = rank < k
            kth[slot[rank == k - 1]] = score[rank == k - 1]
            slot, score, ids, keys = slot[top], score[top], ids[top], keys[top]
    return slot, score, ids, keys


def _search(index: Index, n_positives: int, n_negatives: int, low: int, high: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        q = matrix(pdf["q"].tolist(), index.centers.shape[1], index.exact)
        label, key = pdf["label"].to_numpy(), pdf["key"].to_numpy()
        n = len(pdf)
        ends = np.full(n, np.inf, index.exact)
        slot, score, ids, keys = best(index, q, np.arange(n), label, True, -ends, ends, n_positives + 1)
        own = keys == key[slot]
        # anchors ask once for each score that a positive of theirs has
        pair = list(dict.fromkeys(zip(slot.tolist(), (int(s) for s in score))))
        row = np.array([p[0] for p in pair], np.int64)
        least = np.array([-(-low * s // 100) for _, s in pair], index.exact)
        most = np.array([high * s // 100 for _, s in pair], index.exact)
        n_slot, n_score, n_ids, _ = best(index, q, row, label[row], False, least, most, n_negatives)
        found: list[list] = [[] for _ in pair]
        for i, s, v in zip(n_slot.tolist(), n_score, n_ids.tolist()):
            found[i].append((v, int(s)))
        negatives = dict(zip(pair, found))
        out: list[list] = [[] for _ in range(n)]
        for i, s, v, mine in zip(slot.tolist(), score, ids.tolist(), own.tolist()):
            out[i].append((v, int(s), mine, negatives[i, int(s)]))
        return pd.DataFrame(
            {
                "key": key,
                "times": pdf["times"],
                "ids": [[x[0] for x in r] for r in out],
                "scores": [[x[1] for x in r] for r in out],
                "own": [[x[2] for x in r] for r in out],
                "negatives": [[[v for v, _ in x[3]] for x in r] for r in out],
                "negative_scores": [[[s for _, s in x[3]] for x in r] for r in out],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), BLOCK):
                yield block(pdf.iloc[start : start + BLOCK])

    return run


def build_index(groups: DataFrame) -> Index | None:
    """Write the lists of the distinct rows and keep their centroids and radii; None where there are no rows."""
    spark = groups.sparkSession
    size = F.aggregate("q", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    n, width, largest = groups.agg(F.count("*"), F.max(F.size("q")), F.max(size)).first()
    if not n:
        return None
    sample = [r.q for r in groups.select("q", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(FIT_ROWS).collect()]
    x = matrix(sample, width)
    centers = k_means(x, max(1, min(MOST_LISTS, round(n**0.5), len(sample) // 8)))
    path = scratch(spark, "lists")
    kinds = "key binary, label long, q array<long>, ids array<long>"
    placed = groups.mapInPandas(_assign(centers, True), f"{kinds}, list long, far double")
    placed.repartitionByRange("list", "key").write.partitionBy("list").option("compression", "zstd").parquet(path)
    radii = np.full(len(centers), -np.inf)
    for r in spark.read.schema(f"{kinds}, far double, list long").parquet(path).groupBy("list").agg(F.max("far").alias("far")).collect():
        radii[r.list] = r.far * (1 + 1e-9)
    used = np.flatnonzero(radii >= 0)
    return Index(path, used, centers[used], radii[used], np.float64 if width * largest**2 < 2**53 else np.longdouble)


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """For each anchor (rows where ``anchors`` holds) and each of its ``n_positives`` best rows of the same label, the first ``n_negatives``
    rows of other labels whose score is between ``low`` and ``high`` percent of the positive's.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    asked = integers(rows.where(anchors), id_col, vec_col, label_col, scale).distinct()
    asked = written(asked, "anchors")
    groups = written(collapsed(integers(rows, id_col, vec_col, label_col, scale), max(n_positives + 1, n_negatives)), "vectors")
    index = build_index(groups)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    one = asked.groupBy("key", "label", "q").agg(F.count("*").alias("times"))
    placed = written(one.mapInPandas(_assign(index.centers, False), "key binary, label long, q array<long>, times long, list long"), "asked")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // BLOCK))
    near = placed.repartitionByRange(tasks, "list", "key").sortWithinPartitions("list", "key").select("key", "label", "q", "times")
    result = written(
        near.mapInPandas(
            _search(index, n_positives, n_negatives, low, high),
            "key binary, times long, ids array<long>, scores array<long>, own array<boolean>, negatives array<array<long>>, negative_scores array<array<long>>",
        ),
        "found",
    )
    joined = join_sized(asked.select("vec_id", "key"), result, "key", "times", ["vec_id"])
    entries = joined.withColumn("all", F.arrays_zip("ids", "scores", "own", "negatives", "negative_scores"))
    # its own place among the positives, 0 where it has none
    place = F.array_position(F.transform("all", lambda x: x["own"] & (x["ids"] == F.col("vec_id"))), True)
    others = entries.withColumn("place", place).withColumn("all", F.slice(F.filter("all", lambda x, i: i + 1 != F.col("place")), 1, n_positives))
    pairs = others.select("vec_id", F.explode("all").alias("p"))
    return pairs.select(
        F.col("vec_id").alias("anchor_id"), F.col("p.ids").alias("positive_id"), F.col("p.scores").alias("positive_score"),
        F.posexplode(F.arrays_zip(F.col("p.negatives").alias("id"), F.col("p.negative_scores").alias("score"))).alias("at", "n"),
    ).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"),
    )


ship(__name__)
