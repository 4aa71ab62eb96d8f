"""Prefix trie of conversations, from the Cartesian tree over the LCP array of the sorted conversations.

1. A turn becomes 24 bytes: 16 of the SHA-256 of its role and text, 8 for its words. A conversation is the chain of its
   turns, so bytes compare as turns do. Conversations with equal chains become one row with their number, smallest id and
   the hash of all ids, which is fed in order from pieces that other tasks have joined.
2. The distinct chains are sorted by range; each partition of the sort is a block. A chain's LCP is the number of turns it
   shares with the chain before it; the first of a block is compared with the last of the block before.
3. Every task finds the nearest smaller LCP on both sides of each chain of its block, with a stack. Where a side lies outside
   the block, it keeps one open piece for each depth, and the stairs of the block's prefix and suffix minima. The block minima
   (one number a block) say in which block an open piece ends; that block's stairs say where.
4. Chains with equal LCP and equal smaller neighbours are one node; chains that no other extends are the leaves. All that is
   asked of a node is a sum or minimum over its interval, from prefix sums in a block and sums of whole blocks between.
5. A node stands for all depths between its parent's and its own; these are expanded at last.

What grows: the driver and each task hold eight numbers for each block of ``BLOCK_ROWS`` distinct chains (or shuffle partition,
if those are more). A conversation is one row, 24 bytes a turn. No task holds a group: equal conversations are joined in
pieces, blocks are cut by rows, and a node with many children meets them by block.

Defined cases: turns are ordered by number, null first, then by digest; a null role or text is empty; rows with a null
conversation id take no part; repeated rows are turns of their own; an empty table gives no nodes; a conversation without turns
ends at the root; columns that are not named are not looked at. Ids and turn numbers are longs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, count_words, ship, written

BLOCK_ROWS = 200_000
TURN = 24
NONE = np.iinfo(np.int64).max
NODE, OPEN, LEFT_STAIR, RIGHT_STAIR, SUM = range(5)
DIRECT, TO_LEFT, TO_RIGHT, TOP = range(4)  # how a node finds its parent
PIECES = "kind int, block long, v long, side int, a long, la long, lb long, cnt long, n long, leaves long, words long, fresh long, least long, how int, parent long, pblock long"
NODES = ["a", "v", "la", "lb", "cnt", "n", "leaves", "words", "fresh", "least", "how", "parent", "pblock"]
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def chains(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its chain of turns."""
    rows = columns(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id IS NOT NULL")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32))
    words = F.lpad(F.hex(count_words(F.col("text")).cast("long")), 16, "0")
    keyed = rows.select("conv_id", "turn", F.unhex(F.concat(digest, words)).alias("key"))
    entry = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "key")
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.hex(x["key"]))
    return keyed.groupBy("conv_id").agg(F.unhex(F.array_join(listed, "")).alias("chain"))


def branched(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that share openings: the first h turns of conversation c - c % ``every``, then the own turns after the first h.

    h is the CRC-32 of the id's digits modulo ``most``. ``convs`` is read twice.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)) * TURN
    donor = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_donor"), F.substring("chain", 1, TURN * (most - 1)).alias("_head"))
    rows = convs.withColumn("_donor", donor).withColumn("_h", h.cast("int")).join(heads, "_donor", "left")
    none = F.unhex(F.lit(""))
    own = F.substring(F.col("chain"), F.col("_h") + 1, F.octet_length("chain"))
    return rows.select("conv_id", F.concat(F.coalesce(F.substring(F.col("_head"), F.lit(1), F.col("_h")), none), own).alias("chain"))


# --- 1 distinct chains ---------------------------------------------------------------------------------------------


def _join_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each run of equal chains in a batch, with the ids joined."""
    for pdf in batches:
        key = pdf["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        ends = np.append(starts[1:], len(key))
        ids = pdf["conv_id"].tolist()
        yield pd.DataFrame(
            {
                "key": key[starts],
                "chain": pdf["chain"].to_numpy()[starts],
                "first": pdf["conv_id"].to_numpy()[starts],
                "copies": (ends - starts).astype(np.int64),
                "ids": [",".join(map(str, ids[a:b])) for a, b in zip(starts.tolist(), ends.tolist())],
            }
        )


def _hash_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each chain, from its joined ids in order; nothing but the hash's state is kept between rows."""
    names = ["chain", "copies", "first", "ends_sha256"]
    held = None  # key, chain, copies, first, hash
    for pdf in batches:
        out = []
        for key, chain, first, copies, ids in zip(pdf["key"], pdf["chain"], pdf["first"], pdf["copies"], pdf["ids"]):
            if held and held[0] == key:
                held[2] += copies
                held[4].update(b"," + ids.encode())
            else:
                if held:
                    out.append((*held[1:4], held[4].hexdigest()))
                held = [key, chain, copies, first, hashlib.sha256(ids.encode())]
        yield pd.DataFrame(out, columns=names)
    if held:
        yield pd.DataFrame([(*held[1:4], held[4].hexdigest())], columns=names)


def distinct_chains(convs: DataFrame) -> DataFrame:
    """chain, copies, first (smallest conversation id) and the hash of all ids in order."""
    rows = convs.select("conv_id", "chain", F.unhex(F.sha2("chain", 256)).alias("key"))
    runs = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(
        _join_ids, "key binary, chain binary, first long, copies long, ids string"
    )
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInPandas(
        _hash_ids, "chain binary, copies long, first long, ends_sha256 string"
    )


# --- 2 the sorted chains and their LCP -----------------------------------------------------------------------------


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // TURN


def words_before(chain: bytes) -> np.ndarray:
    """At depth d, the words of the first d - 1 turns; 0 at depth 0."""
    words = np.frombuffer(chain, ">i8")[2::3].astype(np.int64)
    return np.concatenate([[0, 0], np.cumsum(words)[:-1]])[: len(words) + 1]


def total_words(chain: bytes) -> int:
    return int(np.frombuffer(chain, ">i8")[2::3].sum())


def fresh_words(chain: bytes, lcp: int) -> int:
    """Words of the turns after the first ``lcp``; of all for -1."""
    return int(np.frombuffer(chain, ">i8")[2::3][max(lcp, 0) :].sum())


def _with_lcp(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row of a sorted block with its LCP; the first and last keep their chains, to be compared with other blocks."""

    def rows(pdf: pd.DataFrame, lcp: list[int]) -> pd.DataFrame:
        own = pdf["chain"].tolist()
        first = np.array([x < 0 for x in lcp], bool)
        return pd.DataFrame(
            {
                "at": pdf["at"],
                "lcp": np.array(lcp, np.int64),
                "length": np.array([len(c) // TURN for c in own], np.int64),
                "copies": pdf["copies"],
                "first": pdf["first"],
                "ends_sha256": pdf["ends_sha256"],
                "before": [words_before(c) for c in own],
                "total": np.array([total_words(c) for c in own], np.int64),
                "fresh": np.array([fresh_words(c, x) for c, x in zip(own, lcp)], np.int64),
                "is_first": first,
                "is_last": False,
                "edge": [c if f else None for c, f in zip(own, first)],
            }
        )

    last, held = None, None
    for pdf in batches:
        lcp = []
        for chain in pdf["chain"]:
            lcp.append(-1 if last is None else shared_turns(last, chain))
            last = chain
        found = rows(pdf, lcp)
        if not len(found):
            continue
        if held is not None:
            yield held
        if len(found) > 1:
            yield found.iloc[:-1]
        held = found.iloc[-1:].copy()
    if held is not None:
        held["is_last"] = True
        held["edge"] = [last]
        yield held


def sorted_chains(distinct: DataFrame) -> DataFrame:
    """The rows of all blocks, written; ``at`` is block << 33 | position."""
    spark = distinct.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // BLOCK_ROWS))
    ordered = distinct.repartitionByRange(blocks, "chain").sortWithinPartitions("chain")
    kept = "lcp long, length long, copies long, first long, ends_sha256 string, before array<long>, total long, fresh long"
    return written(
        ordered.withColumn("at", F.monotonically_increasing_id()).mapInPandas(
            _with_lcp, f"at long, {kept}, is_first boolean, is_last boolean, edge binary"
        ),
        "chains",
    )


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """LCP of a block's first chain with the last one before."""
    a = pdf.loc[~pdf["mine"], "edge"].tolist()
    b, block = pdf.loc[pdf["mine"], "edge"].iloc[0], pdf.loc[pdf["mine"], "block"].iloc[0]
    lcp = shared_turns(a[0], b) if a else -1
    return pd.DataFrame({"block": [block], "lcp": [lcp], "fresh": [fresh_words(b, lcp)]})


def block_starts(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(block, LCP of its first chain, words that are fresh in it) of each block that has rows, in order."""
    spark = rows.sparkSession
    edges = rows.where("is_first OR is_last").select(F.shiftright("at", 33).alias("block"), "is_first", "is_last", "edge")
    blocks = sorted(r[0] for r in edges.where("is_first").select("block").collect())
    after = spark.createDataFrame(list(zip(blocks, [*blocks[1:], -1])), "block long, next long")
    mine = edges.where("is_first").select("block", F.lit(True).alias("mine"), "edge")
    before = edges.where("is_last").join(F.broadcast(after), "block").where("next >= 0").select(F.col("next").alias("block"), F.lit(False).alias("mine"), "edge")
    met = mine.unionByName(before).groupBy("block").applyInPandas(_meet, "block long, lcp long, fresh long")
    return sorted((r.block, r.lcp, r.fresh) for r in met.collect())


# --- 3 nearest smaller values in a block ---------------------------------------------------------------------------


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller values before (-1: none) and after (length: none)."""
    n = len(values)
    before, after, stack, v = [-1] * n, [n] * n, [], values.tolist()
    for x in range(n):
        while stack and v[stack[-1]] > v[x]:
            after[stack.pop()] = x
        if stack:
            top = stack[-1]
            before[x] = before[top] if v[top] == v[x] else top
        stack.append(x)
    return np.array(before, np.int64), np.array(after, np.int64)


class _Least:
    """Minimum over ranges, from minima over stretches of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 1 << len(self.rows) <= len(values):
            half, low = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over [a, b) for each pair; none may be empty."""
        out, level = np.empty(len(a), np.int64), np.frexp(b - a)[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][a[at]], self.rows[k][b[at] - (1 << int(k))])
        return out


def _local(first: dict[int, tuple[int, int, int, int]]):
    """``first``: of each block the LCP and fresh words of its first chain, the next block and the LCP of its first chain."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        at = pdf["at"].to_numpy()
        n, base, block = len(at), int(at[0]), int(at[0]) >> 33
        lcp, fresh = pdf["lcp"].to_numpy().copy(), pdf["fresh"].to_numpy().copy()
        lcp[0], fresh[0], after_block, after_lcp = first[block]
        length, copies, ids = (pdf[c].to_numpy() for c in ("length", "copies", "first"))
        ahead = np.append(lcp[1:], after_lcp)
        leaf = ahead < length
        total = {"n": copies, "leaves": leaf.astype(np.int64), "words": copies * pdf["total"].to_numpy(), "fresh": fresh}
        total = {k: np.concatenate([[0], np.cumsum(x)]) for k, x in total.items()}
        least = _Least(ids)
        left, right = nearest_smaller(lcp)
        names = [c.split()[0] for c in PIECES.split(", ")]
        found = []

        def over(a: np.ndarray, b: np.ndarray, shift: int = 1) -> dict:
            """Sums over [a, b); fresh words without the first ``shift`` rows."""
            return {k: x[b] - x[a + shift if k == "fresh" else a] for k, x in total.items()}

        def add(kind: int, v: np.ndarray, **more) -> None:
            found.append(pd.DataFrame(dict.fromkeys(names, 0) | {"kind": kind, "block": block, "v": v} | more, index=range(len(v))))

        def nodes(a: np.ndarray, b: np.ndarray, v: np.ndarray, cnt) -> None:
            la, lb = lcp[a], np.append(lcp, after_lcp)[b]
            j = np.where(la >= lb, a, b)  # the border whose LCP is the parent's depth
            here = np.minimum(j, n - 1)
            closed = (j < n) & (left[here] >= 0) & (right[here] < n)
            parent, some = np.zeros(len(v), np.int64), np.flatnonzero(closed)
            parent[some] = least(left[j[some]], right[j[some]])
            how = np.where(closed, DIRECT, np.where(j == n, TO_LEFT, np.where(right[here] == n, TO_RIGHT, TO_LEFT)))
            how[np.maximum(la, lb) < 0] = TOP
            own = {"a": base + a, "la": la, "lb": lb, "cnt": cnt, "least": least(a, b), "how": how, "parent": parent}
            add(NODE, v, **own, **over(a, b), pblock=np.where(j == n, after_block, block))

        if len(x := np.flatnonzero((left >= 0) & (right < n))):
            _, at_first, cnt = np.unique(np.stack([left[x], lcp[x]]), axis=1, return_index=True, return_counts=True)
            one = x[at_first]
            nodes(left[one], right[one], lcp[one], cnt)
        if len(x := np.flatnonzero(leaf)):
            nodes(x, x + 1, length[x], 0)
        sides = (left < 0) + 2 * (right == n)  # 1: open before, 2: open after, 3: both
        if len(x := np.flatnonzero((sides > 0) & (lcp >= 0))):
            pair, cnt = np.unique(np.stack([lcp[x], sides[x]]), axis=1, return_counts=True)
            add(OPEN, pair[0], side=pair[1], cnt=cnt)
        x = np.flatnonzero(left < 0)
        x = x[np.append(True, lcp[x][1:] != lcp[x][:-1])]
        none = np.zeros(len(x), np.int64)
        before = np.full(len(x), NONE)
        before[x > 0] = least(none[x > 0], x[x > 0])
        add(LEFT_STAIR, lcp[x], a=base + x, least=before, **over(none, x, 0))
        x = np.flatnonzero(right == n)
        x = x[np.append(lcp[x][1:] != lcp[x][:-1], True)]
        add(RIGHT_STAIR, lcp[x], a=base + x, least=least(x, np.full(len(x), n)), **over(x, np.full(len(x), n)))
        ends = np.array([0]), np.array([n])
        add(SUM, np.array([lcp.min()]), least=least(*ends), **over(*ends, 0))
        return pd.concat(found).astype({c: "int32" if c in ("kind", "side", "how") else "int64" for c in names})

    return run


# --- 4 nodes over several blocks -----------------------------------------------------------------------------------


class _Blocks:
    """The block minima and sums, by block in order."""

    def __init__(self, sums: list) -> None:
        sums = sorted(sums, key=lambda r: r.block)
        self.ids = np.array([r.block for r in sums])
        self.low = np.array([r.v for r in sums])
        self.least = np.array([r.least for r in sums])
        self.total = {k: np.concatenate([[0], np.cumsum([r[k] for r in sums])]) for k in ("n", "leaves", "words", "fresh")}

    def last_below(self, i: int, v: int) -> int:
        return int(np.flatnonzero(self.low[:i] < v)[-1])

    def next_below(self, i: int, v: int) -> int:
        found = np.flatnonzero(self.low[i + 1 :] < v)
        return i + 1 + int(found[0]) if len(found) else len(self.low)


def _between(blocks: _Blocks):
    """The blocks in which the nodes of open pieces begin and end; the last one's number is the number of blocks where nothing is below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            i = np.searchsorted(blocks.ids, pdf["block"].to_numpy()).tolist()
            v, side = pdf["v"].tolist(), pdf["side"].tolist()
            start = [blocks.last_below(k, d) if s & 1 else k for k, d, s in zip(i, v, side)]
            end = [blocks.next_below(k, d) if s & 2 else k for k, d, s in zip(i, v, side)]
            yield pdf.assign(start=np.array(start, np.int64), end=np.array(end, np.int64))

    return run


def _climb(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block's stairs on one side: for each asked depth the step nearest to the border that is lower."""
    ask = pdf[pdf["asked"]]
    stairs = pdf[~pdf["asked"]].sort_values("v")  # steps nearer to the border are higher
    at = np.searchsorted(stairs["v"].to_numpy(), ask["v"].to_numpy(), side="left") - 1
    step = stairs.iloc[at].reset_index(drop=True)
    return step.rename(columns={"v": "step"}).assign(v=ask["v"].to_numpy())[["index", "dir", "v", "step", "a", "n", "leaves", "words", "fresh", "least"]]


def _complete(blocks: _Blocks):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            start, end = pdf["start"].to_numpy(), pdf["end"].to_numpy()
            out = pdf[["a", "v", "cnt"]].copy()
            out["la"], out["lb"] = pdf["la"], pdf["lb"]
            for k in ("n", "leaves", "words", "fresh"):
                out[k] = pdf[f"l_{k}"] + pdf[f"r_{k}"] + blocks.total[k][end] - blocks.total[k][start + 1]
            middle = np.array([blocks.least[s + 1 : e].min(initial=NONE) for s, e in zip(start, end)], np.int64)
            out["least"] = np.minimum(np.minimum(pdf["l_least"].to_numpy(), pdf["r_least"].to_numpy()), middle)
            la, lb = out["la"].to_numpy(), out["lb"].to_numpy()
            out["how"] = np.where(np.maximum(la, lb) < 0, TOP, np.where(la >= lb, TO_RIGHT, TO_LEFT)).astype(np.int32)
            out["parent"] = np.int64(0)
            out["pblock"] = blocks.ids[np.where(la >= lb, start, np.minimum(end, len(blocks.ids) - 1))]
            out["start"], out["end"] = start, end
            yield out

    return run


def spanning_nodes(parts: DataFrame, blocks: _Blocks) -> tuple[DataFrame, DataFrame]:
    """The nodes that reach over block borders, written, and (block, v, how, least) for each open piece that leads to one."""
    spark = parts.sparkSession
    pieces = parts.where(F.col("kind") == OPEN).select("block", "v", "side", "cnt")
    placed = written(pieces.mapInPandas(_between(blocks), "block long, v long, side int, cnt long, start long, end long"), "pieces")
    nodes = placed.groupBy("start", "end", "v").agg(F.sum("cnt").alias("cnt"))
    index = spark.createDataFrame(list(enumerate(blocks.ids.tolist())), "index long, block long")
    stairs = (
        parts.where(F.col("kind").isin(LEFT_STAIR, RIGHT_STAIR))
        .join(F.broadcast(index), "block")
        .withColumn("dir", F.when(F.col("kind") == LEFT_STAIR, "end").otherwise("start"))
        .select("index", "dir", "v", "a", "n", "leaves", "words", "fresh", "least", F.lit(False).alias("asked"))
    )
    none = [F.lit(0).cast("long").alias(c) for c in ("a", "n", "leaves", "words", "fresh", "least")]
    asks = [nodes.select(F.col(d).alias("index"), F.lit(d).alias("dir"), "v", *none, F.lit(True).alias("asked")) for d in ("start", "end")]
    asks[1] = asks[1].where(F.col("index") < len(blocks.ids))
    step = stairs.unionByName(asks[0]).unionByName(asks[1]).groupBy("index", "dir").applyInPandas(
        _climb, "index long, dir string, v long, step long, a long, n long, leaves long, words long, fresh long, least long"
    )
    step = written(step, "steps")
    sums = ("n", "leaves", "words", "fresh", "least")
    lower = step.where("dir = 'start'").select(F.col("index").alias("start"), "v", "a", F.col("step").alias("la"), *(F.col(c).alias(f"l_{c}") for c in sums))
    upper = step.where("dir = 'end'").select(F.col("index").alias("end"), "v", F.col("step").alias("lb"), *(F.col(c).alias(f"r_{c}") for c in sums))
    rest = dict.fromkeys([f"r_{c}" for c in sums], 0) | {"r_least": int(NONE), "lb": -1}  # of nodes that no lower chain follows
    whole = nodes.join(lower, ["start", "v"]).join(upper, ["end", "v"], "left")
    whole = whole.withColumns({c: F.coalesce(F.col(c), F.lit(x).cast("long")) for c, x in rest.items()})
    kinds = {c: "int" if c == "how" else "long" for c in NODES}
    order = ["a", "v", "cnt", "la", "lb", "n", "leaves", "words", "fresh", "least", "how", "parent", "pblock"]
    done = written(whole.mapInPandas(_complete(blocks), ", ".join(f"{c} {kinds[c]}" for c in order) + ", start long, end long"), "spans")
    ways = F.when(F.col("side") == 1, F.array(F.lit(TO_LEFT))).when(F.col("side") == 2, F.array(F.lit(TO_RIGHT))).otherwise(F.array(F.lit(TO_LEFT), F.lit(TO_RIGHT)))
    leads = placed.join(done.select("start", "end", "v", "least"), ["start", "end", "v"]).select("block", "v", F.explode(ways).alias("how"), "least")
    return done.select(*NODES), leads


# --- 5 all depths --------------------------------------------------------------------------------------------------


def trie(convs: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of ``convs`` (conv_id, chain)."""
    spark = convs.sparkSession
    rows = sorted_chains(written(distinct_chains(convs), "distinct"))
    starts = block_starts(rows)
    if not starts:
        return spark.createDataFrame([], RESULT)
    after = [*((b, lcp) for b, lcp, _ in starts[1:]), (-1, -1)]
    first = {b: (lcp, fresh, *ahead) for (b, lcp, fresh), ahead in zip(starts, after)}
    slim = rows.select(F.shiftright("at", 33).alias("block"), "at", "lcp", "length", "copies", "first", "total", "fresh")
    parts = written(slim.groupBy("block").applyInPandas(_local(first), PIECES), "parts")
    blocks = _Blocks(parts.where(F.col("kind") == SUM).select("block", "v", "n", "leaves", "words", "fresh", "least").collect())
    spans, leads = spanning_nodes(parts, blocks)
    nodes = parts.where(F.col("kind") == NODE).select(*NODES).unionByName(spans).withColumn("pd", F.greatest("la", "lb"))
    known = nodes.where(F.col("how").isin(DIRECT, TOP)).withColumn("parent", F.when(F.col("how") == DIRECT, F.col("parent")))
    led = nodes.where(F.col("how").isin(TO_LEFT, TO_RIGHT)).join(
        leads.select(F.col("block").alias("pblock"), F.col("v").alias("pd"), "how", F.col("least").alias("led")), ["pblock", "pd", "how"]
    )
    whole = known.unionByName(led.withColumn("parent", F.col("led")).select(*known.columns))
    expanded = whole.join(rows.select(F.col("at").alias("a"), "length", "before", "total", "ends_sha256"), "a").select(
        *whole.columns, "length", "total", "ends_sha256", F.posexplode(F.slice("before", (F.col("pd") + 2).cast("int"), (F.col("v") - F.col("pd")).cast("int"))).alias("step", "earlier")
    )
    depth = F.col("pd") + 1 + F.col("step")
    inner = depth < F.col("v")
    children = F.when(inner, 1).otherwise(F.col("cnt") + (F.col("length") > F.col("v")).cast("long"))
    return expanded.select(
        F.col("least").alias("conv_id"),
        depth.cast("long").alias("depth"),
        F.when(F.col("step") > 0, F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        children.cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("words") - F.col("n") * F.col("earlier") - F.col("fresh") - F.col("total") + F.col("earlier")).alias("saved_tokens"),
        F.when(depth == F.col("length"), F.col("ends_sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, branch: bool = False, **names: str) -> DataFrame:
    """The prefix trie of conversations given by their turns; with ``branch``, of their ``branched`` forms.

    Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. The node's
    text is turn ``depth`` of conversation ``conv_id``.
    """
    convs = written(chains(turns, **names), "convs")
    return trie(branched(convs) if branch else convs)


ship(__name__)
