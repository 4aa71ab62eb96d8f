"""Exact nearest vectors from a stored index of cells, of which a search opens only those that may hold a hit.

Vectors become unit vectors and are written once, by the cell of their nearest center, in several files for a large cell. Centers are
fitted on a bounded sample. By the triangle inequality on angles no vector of a cell is nearer to a query than the angle between query and center less the cell's
radius. A search opens the ``first`` most promising cells of each query, whose k-th score is a floor, then all cells whose bound reaches it. Vectors
are never shuffled again: tasks read some ``FILE_ROWS`` of them at a time and take the queries, each with the cells it opens, from the shared folder, block by
block. A query leaves a task with its k best of these rows that reach its floor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import scratch, written
from ..shipping import ship
from .retrieval import top_k

FIT_ROWS, MOST_CELLS, ROUNDS = 8192, 1024, 8
FILE_ROWS, BLOCK, HITS = 16_384, 256, 1 << 19


@dataclass
class VectorIndex:
    """Where the cells lie, the unit centers, each cell's radius as an angle, the type of ids and the number of files; cells without rows have no radius."""

    path: str
    centers: np.ndarray
    radii: np.ndarray
    kind: str
    files: int


def unit_rows(vectors, width: int) -> np.ndarray:
    """Vectors as rows of length 1; zero vectors stay, others of another length than ``width`` are zero too."""
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if len(v) == width:
            m[i] = v
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def fitted_centers(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centers of ``k`` cells after a fixed number of rounds; a cell without rows keeps its center."""
    centers = x[:k].copy()
    for _ in range(ROUNDS):
        near = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.sqrt((sums * sums).sum(1, keepdims=True))
        centers = np.where(n > 0, np.divide(sums, n, out=np.zeros_like(sums), where=n > 0), centers)
    return centers


def _placed(centers: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            u = unit_rows(pdf["v"].tolist(), centers.shape[1])
            near = (u @ centers.T).argmax(1) if len(u) else np.zeros(0, int)
            far = np.arccos(np.clip((u * centers[near]).sum(1), -1.0, 1.0))
            far[~u.any(axis=1)] = np.pi  # a zero vector scores 0 with all queries
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "u": list(u), "cell": near.astype(np.int32), "far": far})

    return run


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex | None:
    """Write the vectors by cell below the shared folder; None where no row has numbers. The driver holds ``FIT_ROWS`` of them and the centers."""
    spark = vectors.sparkSession
    rows = vectors.where(F.size(vec_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(vec_col).cast("array<double>").alias("v"))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).collect()
    x = unit_rows([r.v for r in sample], width)
    centers = fitted_centers(x, max(1, min(MOST_CELLS, round(n**0.5), len(x) // 8)))
    kind = dict(rows.dtypes)["doc_id"]
    path = scratch(spark, "cells")
    schema = f"doc_id {kind}, u array<double>, cell int, far double"
    placed = rows.mapInPandas(_placed(centers), schema)
    files = max(1, -(-n // FILE_ROWS))
    placed.repartitionByRange(files, "cell", "doc_id").sortWithinPartitions("cell").write.parquet(path)
    radii = np.full(len(centers), -1.0)
    for r in spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.max("far").alias("far")).collect():
        radii[r.cell] = r.far
    return VectorIndex(path, centers, radii, kind, files)


def _bounds(index: VectorIndex):
    """For each query its cells with the most that a vector of them can score, best first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = np.flatnonzero(index.radii >= 0)
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                some = pdf.iloc[at : at + BLOCK]
                q = unit_rows(some["v"].tolist(), index.centers.shape[1])
                gap = np.maximum(angles(q, index.centers[used]) - index.radii[used] - 1e-7, 0.0)
                bound = np.cos(gap) + 1e-9
                order = np.argsort(-bound, axis=1, kind="stable")
                yield pd.DataFrame({"query_id": some["query_id"], "u": list(q), "cells": list(used[order].astype(np.int32)), "bounds": list(np.take_along_axis(bound, order, 1))})

    return run


def _together(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``most`` rows."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= most:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def first_of_rows(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest scores of each row that reach its floor, of equal ones the first columns; -inf is no score."""
    last = min(k, scores.shape[1]) - 1
    least = -np.partition(-scores, last, axis=1)[:, last, None]
    over, even = scores > least, scores == least
    even &= np.cumsum(even, axis=1, dtype=np.int32) <= last + 1 - over.sum(1, keepdims=True)
    return np.nonzero((over | even) & (scores >= floor[:, None]) & (scores > -np.inf))


def _scored(path: str, k: int):
    """Of some vectors the ``k`` best for each query that opens their cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(path)
        for pdf in _together(batches, FILE_ROWS):
            pdf = pdf.sort_values("doc_id", ignore_index=True)
            v, ids, cell = np.stack(pdf["u"].to_numpy()), pdf["doc_id"].to_numpy(), pdf["cell"].to_numpy()
            own = {c: np.flatnonzero(cell == c) for c in np.unique(cell)}
            for block in ds.dataset(root, filesystem=fs, format="parquet").to_batches(batch_size=BLOCK, columns=["query_id", "u", "floor", "cells"]):
                lists = block.column("cells")
                row, opens = np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
                here = np.isin(opens, list(own))
                row, opens = row[here], opens[here]
                if not len(row):
                    continue
                u = np.stack(block.column("u").to_numpy(zero_copy_only=False))
                s = np.full((len(block), len(ids)), -np.inf)
                for c in np.unique(opens):
                    some = row[opens == c]
                    s[np.ix_(some, own[c])] = u[some] @ v[own[c]].T
                floor = np.nan_to_num(block.column("floor").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                rows, best = first_of_rows(np.round(s, 6), floor - 1e-6, k)
                yield pd.DataFrame({"query_id": block.column("query_id").to_numpy(zero_copy_only=False)[rows], "doc_id": ids[best], "score": s[rows, best]})

    return run


def nearest(index: VectorIndex, queries: DataFrame, k: int, first: int = 2) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest vectors of each query (query_id, vector) by cosine, by rounded score, then id."""
    spark = queries.sparkSession
    q = queries.where(F.size("vector") > 0).select("query_id", F.col("vector").cast("array<double>").alias("v"))
    kind = dict(q.dtypes)["query_id"]
    asked = written(q.mapInPandas(_bounds(index), f"query_id {kind}, u array<double>, cells array<int>, bounds array<double>"), "cells-of-queries")
    cells = asked.select("query_id", F.posexplode(F.arrays_zip("cells", "bounds"))).select("query_id", F.col("col.cells").alias("cell"), F.col("col.bounds").alias("bound"), (F.col("pos") + 1).alias("at"))
    stored = spark.read.schema(f"doc_id {index.kind}, u array<double>, cell int, far double").parquet(index.path).select("doc_id", "u", "cell")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() * k * index.files // HITS))

    def opened(some: DataFrame) -> DataFrame:
        """Hits in the cells (cells, floor) of each query, dealt to tasks by query before they are ranked."""
        path = scratch(spark, "asked")
        asked.select("query_id", "u").join(some, "query_id").select("query_id", "u", "floor", "cells").write.parquet(path)
        opens = spark.read.schema("cells array<int>").parquet(path).select(F.explode("cells").alias("cell")).distinct()
        held = stored.join(F.broadcast(opens), "cell", "left_semi")  # at most ``MOST_CELLS`` numbers
        hits = held.mapInPandas(_scored(path, k), f"query_id {kind}, doc_id {index.kind}, score double")
        return hits.repartition(parts, "query_id")

    sure = written(top_k(opened(asked.select("query_id", F.slice("cells", 1, first).alias("cells"), F.lit(None).cast("double").alias("floor"))), k), "hits")
    floor = sure.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = cells_left(cells.where(F.col("at") > first), floor).groupBy("query_id").agg(F.collect_list("cell").alias("cells"), F.max("floor").alias("floor"))
    return top_k(sure.drop("rank").unionByName(opened(rest)), k)


def cells_left(cells: DataFrame, floor: DataFrame) -> DataFrame:
    """Cells that may hold a hit: those whose bound reaches the floor, short of what scores are rounded by, and all where there is none."""
    return cells.join(floor, "query_id", "left").where("floor IS NULL OR bound >= floor - 1e-6")


ship(__name__)
