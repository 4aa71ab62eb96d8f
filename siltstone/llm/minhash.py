"""Near duplicates by fast similarity sketching, banding and exact verification.

1. Every text becomes its shingle set, a sketch of it and one key for each band of the sketch; only the
   keys and a digest of the set are kept. Documents with equal sets form a class, represented by the
   smallest id, so copies never meet in the later steps.
2. Representatives that share a band key are candidates. First each is compared with one pivot, the
   smallest id among the buckets it is in; links to pivots form a forest, whose roots are components.
3. Buckets that still hold several components are compared completely but for pairs of one component. Of small
   buckets the distinct pairs are verified. In large ones the members outside the bucket's main component meet
   all members in tiles of bounded size, inside the tasks; a tile returns links between components, not pairs.
4. The links between components are contracted until none is left.

All comparisons use full shingle sets and integers: 100 * common >= 75 * union. With 32 bands of 4 rows a
pair at similarity 0.75 shares no bucket with probability 5e-6, and less above. There is no cap on bucket
size, partners or candidates.

Defined cases: texts without words have no shingles and are linked with nothing; a text of fewer words than
the shingle length has one shingle of all its words; rows with one doc_id count as one document with several
texts; rows with null doc_id are linked with nothing and keep a null component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, drop_path, join_sized, ship, written

SHINGLE, COORDINATES, ROWS = 5, 128, 4
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * COORDINATES + SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = _SEEDS[-SHINGLE:] | np.uint64(1)


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of all words, if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > 1_000_000:
        known.clear()
    ids = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        ids[i] = h
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(ids.tobytes(), len(words))], np.uint64)
    m = len(ids) - SHINGLE + 1
    h = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        h += ids[k : k + m] * _PLACE[k]
    return np.unique(_mix(h))


def sketch(items: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: one value for each coordinate.

    Each of the first t rounds throws all items into hashed bins and fills the bins that are still
    empty with the least value that fell there; from round t on, round i fills bin i - t. So every
    coordinate is filled, by few rounds for large sets.
    """
    t = COORDINATES
    out, filled = np.full(t, _MAX), np.zeros(t, bool)
    for i in range(2 * t):
        h = _mix(items ^ _SEEDS[i])
        fresh = np.full(t, _MAX)
        if i < t:
            np.minimum.at(fresh, (h % np.uint64(t)).astype(np.intp), h)
        else:
            fresh[i - t] = h.min()
        take = ~filled & (fresh != _MAX)
        out[take] = fresh[take]
        filled |= take
        if filled.all():
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One key for each band of ``ROWS`` coordinates, different from band to band."""
    grid = coordinates.reshape(-1, ROWS)
    h = np.arange(1, len(grid) + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) ^ grid[:, k])
    return h.view(np.int64)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[bytes, int] = {}
    for pdf in batches:
        n, digest, bands = [], [], []
        for text in pdf["text"]:
            items = shingles(text, known)
            n.append(len(items))
            digest.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
            bands.append(band_keys(sketch(items)) if len(items) else np.empty(0, np.int64))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": n, "set_hash": digest, "bands": bands})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[bytes, int] = {}
    for pdf in batches:
        items = [shingles(t, known) for t in pdf["text"]]
        yield pd.DataFrame({"id": pdf["doc_id"], "n": [len(x) for x in items], "items": [x.tobytes() for x in items]})


def linked(common: int, a: int, b: int, percent: int = 75) -> bool:
    return 100 * common >= percent * (a + b - common)


def _check_pairs(percent: int):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["items"], pdf["pivot_items"]):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent))
            yield pdf.loc[keep].drop(columns=["items", "pivot_items"])

    return check


def _common(left: list[np.ndarray], right: list[np.ndarray], cells: int = 1 << 24) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices over slices of the items."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.float32)
    both = left + right
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    items, col, seen = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1  # items of one set only are in no intersection
    row, col = row[seen[col] > 1], shared[col[seen[col] > 1]]
    out = np.zeros((len(left), len(right)), np.float32)
    width = min(max(64, cells // len(both)), len(items))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [start, start + width])
        grid = np.zeros((len(both), width), np.float32)
        grid[row[lo:hi], col[lo:hi] - start] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def _tile_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between components in one tile, as a spanning forest of its components."""
    sides = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    if not all(sides):
        return []
    left, right = ([np.frombuffer(r[2], np.uint64) for r in side] for side in sides)
    common = _common(left, right)
    na, nb = (np.array([len(x) for x in sets]) for sets in (left, right))
    ca, cb = (np.array([r[0] for r in side], np.int64) for side in sides)
    hits = (100 * common >= percent * (na[:, None] + nb[None, :] - common)) & (ca[:, None] != cb[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []
    for i, j in zip(*np.nonzero(hits)):
        x, y = root(int(ca[i])), root(int(cb[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((x, y))
    return found


def _check_tiles(percent: int):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of each tile; the rows come sorted by tile, and one tile is held at a time."""
        tile, rows = None, []
        for pdf in batches:
            links = []
            for key, i, j, comp, minor, items in zip(*(pdf[c] for c in ("key", "i", "j", "comp", "minor", "items"))):
                if (key, i, j) != tile:
                    links += _tile_links(rows, percent)
                    tile, rows = (key, i, j), []
                rows.append((comp, minor, items))
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(_tile_links(rows, percent), columns=["a", "b"], dtype=np.int64)

    return check


def _roots(forest: DataFrame, made: list[str]) -> DataFrame:
    """(id, up) with up < id for all but the roots, which have no row: up becomes each id's root."""
    while True:
        forest = written(forest, "forest", made)
        above = forest.select(F.col("id").alias("up"), F.col("up").alias("top"))
        step = forest.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
        step = written(step, "forest", made)
        if not step.where("moved").head(1):
            return step.select("id", "up")
        forest = step.select("id", "up")


def components(edges: DataFrame, made: list[str]) -> DataFrame | None:
    """(id, comp) for every end of an edge (a, b): the smallest id reachable; None without edges.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots and contracts
    the edges to roots; the nodes left at least halve.
    """
    total = None
    while True:
        edges = written(edges.where("a != b").distinct(), "edges", made)
        if not edges.head(1):
            return total
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("up")).union(edges.select("b", "a"))
        hooks = ends.groupBy("id").agg(F.min("up").alias("up")).where("up < id")
        roots = _roots(hooks, made)
        to = lambda df, c: df.join(roots.select(F.col("id").alias(c), "up"), c, "left").withColumn(c, F.coalesce("up", c)).drop("up")
        edges = to(to(edges, "a"), "b")
        if total is None:
            total = roots.withColumnRenamed("up", "comp")
        else:
            moved = to(total, "comp")
            total = written(moved.unionByName(roots.withColumnRenamed("up", "comp").join(moved.select("id"), "id", "left_anti")), "comps", made)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    small: int = 8,
    block: int = 1024,
    block_items: int = 500_000,
    salted: int = 256,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Buckets of up to ``small`` members are compared pair by pair, each pair once whatever number of buckets it
    shares; larger ones in tiles. ``block`` members or ``block_items`` shingles bound one side of a tile.
    Members of a bucket meet its pivot in groups of some ``salted``, each with the pivot's set of its own.
    """
    made: list[str] = []  # folders of the steps between, deleted once the components are named
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    drawn = written(rows.mapInPandas(_sketches, "doc_id long, n long, set_hash binary, bands array<bigint>"), "sketches")
    usable = drawn.where("n > 0 and doc_id is not null")
    classes = written(
        usable.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes", made
    )
    seats = classes.select("id", F.explode("bands").alias("key"))
    buckets = written(seats.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).where("size > 1"), "buckets", made)
    members = written(seats.join(buckets, "key"), "members", made)
    need = written(members.select("id").distinct(), "need", made)
    sets = written(
        rows.join(need, F.col("doc_id") == F.col("id"), "left_semi").mapInPandas(_sets, "id long, n long, items binary"), "sets", made
    )

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (id, pivot, salt, ...) whose full sets are linked."""
        seen = pairs.select("pivot", "salt").distinct().join(sets.select(F.col("id").alias("pivot"), F.col("items").alias("pivot_items")), "pivot")
        seen = seen.select(F.struct("pivot", "salt").alias("seat"), "pivot_items")  # one key: by the pivot alone, a hot pivot's groups would meet again
        schema = ", ".join(f"{c} long" for c in pairs.columns)
        seated = pairs.join(sets.select("id", "items"), "id").withColumn("seat", F.struct("pivot", "salt"))
        full = seated.join(seen, "seat").select(*pairs.columns, "items", "pivot_items")
        return full.mapInPandas(_check_pairs(percent), schema)

    # of the buckets that a member shares with its pivot, the largest tells into how many groups they are dealt
    nearest = members.groupBy("id").agg(F.min(F.struct("pivot", (-F.col("size")).alias("less"))).alias("at"))
    nearest = nearest.select("id", "at.pivot", F.pmod(F.xxhash64("id"), F.ceil(-F.col("at.less") / salted)).alias("salt")).where("pivot < id")
    first = _roots(verified(nearest).distinct().select("id", F.col("pivot").alias("up")), made)

    at = members.drop("size").join(first, "id", "left").select("key", "id", F.coalesce("up", "id").alias("comp"))
    weights = need.join(sets.groupBy("id").agg(F.max("n").alias("n")), "id")
    at = written(at.join(weights, "id"), "placed", made)
    sizes = at.groupBy("key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("items"))
    parts = lambda n, items: F.ceil(F.greatest(n / block, items / block_items)).cast("int")
    mixed = written(
        sizes.groupBy("key")
        .agg(
            F.count("*").alias("comps"),
            F.max(F.struct("size", "items", "comp")).alias("main"),
            F.sum("size").alias("size"),
            F.sum("items").alias("items"),
        )
        .where("comps > 1")
        .select(
            "key",
            "size",
            F.col("main.comp").alias("main"),
            parts(F.col("size"), F.col("items")).alias("blocks"),
            parts(F.col("size") - F.col("main.size"), F.col("items") - F.col("main.items")).alias("minor_blocks"),
        ),
        "mixed",
        made,
    )
    placed = at.join(mixed, "key")
    few = placed.where(F.col("size") <= small).select("key", "id", "comp")
    others = few.select("key", F.col("id").alias("pivot"), F.col("comp").alias("pivot_comp"))
    pairs = few.join(others, "key").where("pivot < id and pivot_comp != comp").select("id", "pivot", F.lit(0).cast("long").alias("salt"), "comp", "pivot_comp").distinct()
    near = verified(pairs).select(F.col("comp").alias("a"), F.col("pivot_comp").alias("b"))

    many = placed.where(F.col("size") > small)
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    majors = many.withColumn("minor", F.lit(False)).withColumn("j", spread(F.col("blocks"), 1)).withColumn("i", every("minor_blocks"))
    minors = (
        many.where("comp != main")
        .withColumn("minor", F.lit(True))
        .withColumn("i", spread(F.col("minor_blocks"), 2))
        .withColumn("j", every("blocks"))
    )
    cells = majors.unionByName(minors).select("key", "i", "j", "id", "comp", "minor")
    tiles = (
        cells.join(sets.select("id", "items"), "id")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInPandas(_check_tiles(percent), "a long, b long")
    )
    links = near.unionByName(tiles)
    second = components(links, made)
    named = classes.select("set_hash", "id", "copies").join(first, "id", "left").withColumn("comp", F.coalesce("up", "id")).drop("up")
    if second is not None:
        up = second.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        named = named.join(up, "comp", "left").withColumn("comp", F.coalesce("top", "comp"))
    named = written(named.select("set_hash", "copies", "comp"), "named")
    for path in made:
        drop_path(docs.sparkSession, path)
    marked = drawn.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("set_hash")).alias("set_hash"))
    return join_sized(marked, named, "set_hash", "copies", ["doc_id"]).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("comp", "doc_id").alias("component_id"),
        F.coalesce(F.col("comp") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


ship(__name__)
