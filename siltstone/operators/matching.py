"""Approximate joins of short texts by edit distance or matching blocks, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from ..shipping import ship

GRAM = 2


def edits_allowed(n: Column, threshold: float) -> Column:
    """Most edits between a text of n characters and one with 1 - distance / longest >= threshold."""
    return F.floor(F.lit((1 - threshold) / threshold) * n + 1e-9).cast("int")


def near_texts(left: DataFrame, right: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """(by..., left, right, ratio) of the distinct texts (column ``text``) of two frames with ratio >= threshold.

    Pairs of which the longer text allows one edit at most have a form in common that lacks one letter or none: they meet on
    these forms. For the others, an edit changes at most ``GRAM`` of a text's pairs of letters, so of the rarest GRAM * edits + 1
    pairs of either text one is among those of the other: they meet on rare pairs of letters. What all
    texts share (a common first word, for example) never joins anything.
    """
    by = by or []
    distinct = [df.select(*by, "text").where("text != ''").distinct() for df in (left, right)]
    longest = F.greatest(F.length("left"), F.length("right"))
    alone = int(2 / (1 - threshold) - 1e-9)  # the most letters of a text that allows one edit
    short = [df.where(F.length("text") <= alone) for df in distinct]
    spots = F.sequence(F.lit(0), F.length("text"))
    forms = F.array_distinct(F.transform(spots, lambda i: F.concat(F.substring("text", F.lit(1), i - 1), F.substring("text", i + 1, F.length("text")))))
    formed = [df.select(*by, F.col("text").alias(name), F.explode(F.array_union(F.array("text"), forms)).alias("form")) for df, name in zip(short, ("left", "right"))]
    pairs = formed[0].join(formed[1], [*by, "form"])

    # longer texts: at least one of the two allows more than one edit
    least = int(threshold * (alone + 1))

    def grams(df: DataFrame) -> DataFrame:
        starts = F.sequence(F.lit(1), F.greatest(F.length("text") - GRAM + 1, F.lit(1)))
        return df.where(F.length("text") >= least).select(*by, "text", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(GRAM))))).alias("gram"))

    both = [grams(df) for df in distinct]
    df = both[0].unionByName(both[1]).groupBy("gram").agg(F.count("*").alias("df"))
    w = Window.partitionBy(*by, "text").orderBy("df", "gram")

    def prefix(g: DataFrame, name: str) -> DataFrame:
        ranked = g.join(df, "gram").withColumn("rn", F.row_number().over(w))
        return ranked.where(F.col("rn") <= GRAM * edits_allowed(F.length("text"), threshold) + 1).select(*by, "gram", F.col("text").alias(name))

    lefts, rights = prefix(both[0], "left"), prefix(both[1], "right")
    over = lambda c: F.length(c) > alone
    met = lefts.where(over("left")).join(rights, [*by, "gram"]).unionByName(lefts.where(~over("left")).join(rights.where(over("right")), [*by, "gram"]))
    pairs = pairs.drop("form").unionByName(met.drop("gram"))
    pairs = pairs.where(F.abs(F.length("left") - F.length("right")) <= longest * F.lit(1 - threshold) + 1e-9).select(*by, "left", "right").distinct()
    return pairs.withColumn("ratio", 1 - F.levenshtein("left", "right") / longest).where(F.col("ratio") >= threshold)


# --- texts that hold a string ------------------------------------------------------------------------------------


def _grams(text: Column, size: Column) -> Column:
    """All stretches of ``size`` letters of a text; none where it is shorter."""
    last = F.length(text) - size + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))


def containing(texts: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, probe) of the texts (id, text) that hold a string of ``probes`` (probe) anywhere, also inside a word; blank probes match nothing.

    A text that holds a probe has a word that holds the probe's longest word. Distinct words meet distinct probes on the rarest three
    letters of that longest word (all of it, if shorter), so neither texts nor words meet all probes; texts are read by word. Probes of
    several words are compared with the whole texts that are left.
    """
    longest = F.array_max(F.transform(F.split(F.trim("probe"), r"\s+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = written(probes.select("probe").where(F.trim("probe") != "").distinct().withColumn("key", longest), "probes")
    keys = asked.select("key").distinct().withColumn("size", F.least(F.length("key"), F.lit(3)))
    sizes = sorted(r[0] for r in keys.select("size").distinct().collect())  # of 1, 2 and 3
    if not sizes:
        return texts.select("id").join(asked.select("probe"), F.lit(False))
    words = texts.select("id", F.explode(F.array_distinct(F.split(F.trim("text"), r"\s+"))).alias("word")).where("word != ''")
    known = words.select("word").distinct()
    cut = F.array_distinct(F.concat(*(_grams(F.col("word"), F.lit(n)) for n in sizes)))
    wanted = keys.select("key", F.explode(F.array_distinct(_grams(F.col("key"), F.col("size")))).alias("gram"))
    held = written(known.select("word", F.explode(cut).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"), "grams")
    df = held.groupBy("gram").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "gram"))
    rarest = wanted.join(df, "gram", "left").fillna(0, ["df"]).withColumn("rank", rank).where("rank = 1").select("key", "gram")
    met = held.join(rarest, "gram").where(F.contains("word", "key")).select("word", "key")
    found = words.join(met, "word").select("id", "key").distinct().join(asked, "key")
    more = found.where("probe != key").join(texts.select("id", "text"), "id").where(F.contains("text", "probe"))
    return found.where("probe = key").select("id", "probe").unionByName(more.select("id", "probe"))


# --- ratio of matching blocks ------------------------------------------------------------------------------------


def block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """2 * matched / letters, over the longest common block of two texts and, in turn, of what is before and after it."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def common_letters(a: Column, b: Column) -> Column:
    """Letters of ``a`` that find one of their own in ``b``, in any order: no more than these can match."""
    times = lambda text, letter: F.length(text) - F.length(F.replace(text, letter, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def _without_one(text: Column) -> Column:
    """The text without its first letter, without its second, and so on."""
    n = F.length(text)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))


def pieces_met(texts: dict[str, DataFrame], pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., left, right), repeated, of texts that hold a piece of the other near its place, for ``pairs`` of lengths and the letters they may lose.

    All pieces but one for each lost letter stand in the other text.
    """
    lost = F.col("left_gone") + F.col("right_gone")
    more = pairs.withColumn("lost", lost).withColumn("cuts", F.explode(F.array(lost + 1, 2 * (lost + 1)))).where("cuts <= left_n OR cuts = lost + 1")
    key = [*by, "left_n", "right_n", "cuts", "piece", "string"]
    begin, size = "(i * left_n div cuts)", "((i + 1) * left_n div cuts - i * left_n div cuts)"
    cut = F.expr(f"transform(sequence(0, cuts - 1), i -> struct(i AS piece, substring(`left`, cast({begin} AS int) + 1, cast({size} AS int)) AS string))")
    places = f"filter(transform(sequence(-left_gone, right_gone), p -> {begin} + p), p -> p >= 0 AND p + {size} <= right_n)"
    moved = f"transform({places}, p -> struct(i AS piece, substring(`right`, cast(p AS int) + 1, cast({size} AS int)) AS string))"
    near_places = F.expr(f"flatten(transform(sequence(0, cuts - 1), i -> {moved}))")
    pieces = texts["left"].join(more, [*by, "left_n"]).select(*by, "left", "left_n", "right_n", "cuts", "lost", F.inline(cut))
    held = texts["right"].join(more, [*by, "right_n"]).select(*by, "right", "left_n", "right_n", "cuts", F.inline(F.array_distinct(near_places)))
    held = written(held, "pieces")
    one = [*by, "left", "right_n", "cuts"]
    ranked = pieces.join(held.groupBy(*key).agg(F.count("*").alias("df")), key, "left").fillna(0, ["df"]).withColumn("rank", F.row_number().over(Window.partitionBy(*one).orderBy("df", "piece")))
    rare = ranked.where("rank <= lost + 1").withColumn("cost", F.sum("df").over(Window.partitionBy(*one)))  # of the pieces that are looked up one is held
    rare = rare.withColumn("best", F.min(F.struct("cost", "cuts")).over(Window.partitionBy(*by, "left", "right_n"))).where("best.cuts = cuts AND df > 0")
    return rare.select("left", *key).join(held.hint("merge"), key).select(*by, "left", "right")


def matching_texts(left: DataFrame, right: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """(by..., left, right, ratio) of the distinct texts (column ``text``) of two frames whose ``block_ratio`` reaches the threshold.

    Texts of l and r letters need m = ceil(threshold * (l + r) / 2) matched ones, so at most l - m and r - m are not. Where that is
    one at most on either side, the texts have a form in common that lacks one letter or none. Otherwise the left text is cut into pieces,
    more than there are letters not matched on both sides: each such letter spoils one piece, so of the rarest pieces but one more than these letters one
    stands in the right text, moved by no more than these letters. Long pieces that are all looked up or pieces of half the length,
    whichever meet fewer texts; these pairs are thinned by their letters' number, whatever the order, before the blocks are compared. Which
    lengths meet is known from the lengths that occur. Stored texts look small, many times smaller than their forms and pieces, so these are merged and
    never broadcast. The ratio depends on the order of the two texts.
    """
    if threshold < 0.8:
        raise ValueError("pieces say little about texts that are less alike than 0.8")
    by = by or []
    sides = {"left": left, "right": right}
    texts = {x: written(_sized(df, x, by), "texts") for x, df in sides.items()}  # read by every step below
    pairs = lengths_met(texts, threshold, by)

    formed = []
    for x, df in texts.items():
        short = df.join(pairs.where(FEW).select(*by, f"{x}_n").distinct(), [*by, f"{x}_n"], "left_semi")
        formed.append(short.select(*by, x, F.explode(_forms(F.col(x))).alias("form")))
    found = formed[0].join(formed[1].hint("merge"), [*by, "form"]).select(*by, "left", "right")

    likely = _likely(found, texts, pairs, threshold, by)
    return likely.withColumn("ratio", _ratio()("left", "right")).where(F.col("ratio") >= threshold)


def _sized(texts: DataFrame, name: str, by: list[str]) -> DataFrame:
    return texts.select(*by, F.col("text").alias(name), F.length("text").alias(f"{name}_n")).where(F.col(name) != "").distinct()


#: Lengths of texts of which one letter at most is not matched on either side.
FEW = "left_gone <= 1 AND right_gone <= 1"


def lengths_met(texts: dict[str, DataFrame], threshold: float, by: list[str]) -> DataFrame:
    """(by..., left_n, right_n, least, left_gone, right_gone), written: the lengths that meet, the letters that are to match and those that may not."""
    lengths = {x: df.select(*by, f"{x}_n").distinct() for x, df in texts.items()}
    near = (2 - threshold) / threshold + 1e-9  # lengths differ by this factor at most
    partners = F.sequence(F.ceil(F.col("left_n") / near).cast("int"), F.floor(F.col("left_n") * near).cast("int"))
    pairs = lengths["left"].withColumn("right_n", F.explode(partners)).join(lengths["right"], [*by, "right_n"])
    matched = F.ceil(threshold * (F.col("left_n") + F.col("right_n")) / 2 - 1e-9).cast("int")
    pairs = pairs.withColumn("least", matched).withColumns({"left_gone": F.col("left_n") - F.col("least"), "right_gone": F.col("right_n") - F.col("least")})
    return written(pairs.where("left_gone >= 0 AND right_gone >= 0"), "lengths")


def _forms(text: Column) -> Column:
    return F.array_distinct(F.array_append(_without_one(text), text))


def _likely(found: DataFrame | None, texts: dict[str, DataFrame], pairs: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """(by..., left, right), once each, dealt out: pairs that were found and those that meet on pieces and have enough letters in common."""
    met = pieces_met(texts, pairs.where(f"NOT ({FEW})"), by)
    both = F.length("left") + F.length("right")
    met = met.distinct().where(2 * common_letters(F.col("left"), F.col("right")) >= threshold * both - 1e-9)
    rows = met if found is None else found.unionByName(met)
    return rows.repartition(_tasks(rows), "left", "right").distinct()


def _tasks(df: DataFrame) -> int:
    """For small rows, but dear ones: not to be put together by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ratio():
    return F.pandas_udf(block_ratio, "double").asNondeterministic()  # so that a filter by it stays after the shuffle


# --- close texts counted where they meet -------------------------------------------------------------------------

PAIRS, CELLS = 1 << 16, 1 << 22  # pairs that are made at once; places in two texts that are compared at once
JUNK = 200  # letters of a right text from which the matcher leaves out common ones


def blocks_reach(left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Whether ``block_ratio`` matches ``least`` letters at least, for pairs of rows of letters; right rows of fewer than ``JUNK`` letters.

    Every round takes the longest common block of all stretches that are left, of equal ones the first on the left, then on the right. A pair is
    given up when what is left of it can't reach ``least``.
    """
    n, m = left.shape[1], right.shape[1]
    reached = np.zeros(len(left), bool)
    pair = np.arange(len(left) if min(n, m) >= least else 0)
    got, room = np.zeros(len(left), np.int64), np.full(len(left), min(n, m), np.int64)
    a0, b0 = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
    a1, b1 = a0 + n, b0 + m
    while len(pair):
        top, tail, first, last = a0.min(), a1.max(), b0.min(), b1.max()
        a, b = left[pair, top:tail].T, right[pair, first:last].T
        a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
        at = np.arange(first, last)[:, None]
        beside = None if (b0 == first).all() and (b1 == last).all() else (at >= b0) & (at < b1)
        run = np.zeros((len(a) + 1, len(b) + 1, len(pair)), np.uint8)  # letters of the block that ends at two places
        size, ends = np.zeros(len(pair), np.uint8), np.zeros(len(pair), np.int64)
        for k in range(len(a)):
            same = b == a[k]
            if beside is not None:
                same &= beside
            np.add(run[k, :-1], 1, out=run[k + 1, 1:])
            run[k + 1, 1:] *= same
            if (outside := (a0 > k + top) | (a1 <= k + top)).any():
                run[k + 1][:, outside] = 0
            most = run[k + 1].max(0)
            ends[most > size] = k
            np.maximum(size, most, out=size)
        width = (run[ends + 1, 1:, np.arange(len(pair))] == size[:, None]).argmax(1)
        size = size.astype(np.int64)
        i, j = ends + top + 1 - size, width + first + 1 - size
        before, after = np.minimum(i - a0, j - b0), np.minimum(a1 - i, b1 - j) - size
        before[size == 0] = after[size == 0] = 0
        np.add.at(got, pair, size)
        np.add.at(room, pair, before + after - np.minimum(a1 - a0, b1 - b0))
        reached[pair] |= got[pair] >= least
        open_ = ~reached[pair] & (got[pair] + room[pair] >= least)
        x, y = open_ & (before > 0), open_ & (after > 0)
        pair = np.concatenate([pair[x], pair[y]])
        a0, b0, a1, b1 = (np.concatenate([u[x], v[y]]) for u, v in ((a0, i + size), (b0, j + size), (i, a1), (j, b1)))
    return reached


def _close(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    n, m = left.shape[1], right.shape[1]
    if m >= JUNK:
        text = lambda x: x.astype("<u4").tobytes().decode("utf-32-le")
        return np.array([SequenceMatcher(None, text(a), text(b)).ratio() >= threshold for a, b in zip(left, right)], bool)
    least = next((k for k in range(min(n, m) + 1) if 2.0 * k / (n + m) >= threshold), None)
    if least is None:
        return np.zeros(len(left), bool)
    some = max(1, CELLS // ((n + 1) * (m + 1)))
    return np.concatenate([blocks_reach(left[k : k + some], right[k : k + some], least) for k in range(0, len(left), some)] or [np.zeros(0, bool)])


def _forms_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many forms two rows of letters share that have one: two where their middles are shifted either way, else one."""
    if left.shape[1] != right.shape[1]:
        return np.ones(len(left), np.int64)
    differ = left != right
    first, last = differ.argmax(1)[:, None], left.shape[1] - 1 - differ[:, ::-1].argmax(1)[:, None]
    at = np.arange(left.shape[1] - 1)
    out = (at < first) | (at >= last)
    ways = [((x[:, 1:] == y[:, :-1]) | out).all(1) for x, y in ((left, right), (right, left))]
    return np.where(first[:, 0] == last[:, 0], 1, ways[0].astype(np.int64) + ways[1])


def _few(n: int, m: int, threshold: float) -> bool:
    """As ``FEW`` for two lengths."""
    least = ceil(threshold * (n + m) / 2 - 1e-9)
    return least <= min(n, m) and max(n, m) - least <= 1


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of links, and what has their labels, the least label among them; labels are places in ``label``."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, above := label[label]):
            label[:] = above


def _counted(groups: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows (form_n, at, first, last, text) of whole groups with a form in common: twice the row's share of close texts, and the row of its class."""
    at = groups["at"].to_numpy()
    size = np.diff(np.append(np.flatnonzero(at == 1), len(at)))
    size = np.repeat(size, size)
    partners = size - at  # the rows of a group after this one
    short = groups["form_n"].to_numpy()
    lengths = pc.utf8_length(groups["text"]).to_numpy()
    letters = np.frombuffer("".join(groups["text"].to_pylist()).encode("utf-32-le"), "<u4")
    letters = letters.astype(np.uint8) if not len(letters) or letters.max() < 256 else letters
    begin = np.cumsum(lengths) - lengths
    firsts, lasts = groups["first"], groups["last"]
    many = lasts.is_valid().to_numpy()
    shares, label = np.zeros(len(at), np.int64), np.arange(len(at))
    through = np.cumsum(partners)
    row = 0
    while row < len(at):
        stop = max(row + 1, int(np.searchsorted(through, (through[row - 1] if row else 0) + PAIRS)))
        count = partners[row:stop]
        a = np.repeat(np.arange(row, stop), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        linked_a, linked_b = [], []
        kinds = lengths[a] * (1 << 20) + lengths[b]
        for kind in np.unique(kinds):
            n, m = int(kind) >> 20, int(kind) & ((1 << 20) - 1)
            if not _few(n, m, threshold):
                continue
            x, y = a[kinds == kind], b[kinds == kind]
            left, right = (letters[begin[z][:, None] + np.arange(k)] for z, k in ((x, n), (y, m)))
            close = _close(left, right, threshold)
            other = np.flatnonzero(~close & many[x])  # a name of several ids, of which one may come after the other's first
            if len(other):
                later = pc.less(firsts.take(pa.array(y[other])), lasts.take(pa.array(x[other]))).to_numpy(zero_copy_only=False)
                other = other[later.astype(bool)]
                close[other] = _close(right[other], left[other], threshold)
            x, y = x[close], y[close]
            share = 2 // _forms_shared(left[close], right[close])
            shares += np.bincount(x, share, len(at)).astype(np.int64) + np.bincount(y, share, len(at)).astype(np.int64)
            linked_a.append(x)
            linked_b.append(y)
        if linked_a:
            _joined(label, np.concatenate(linked_a), np.concatenate(linked_b))
        row = stop
    return shares, label


def _counts(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, shares, near) of rows (form_n, at, first, last, text) that are sorted into groups; a group that isn't over waits for the next batch."""
    held = None

    def found(groups: pa.Table) -> Iterator[pa.RecordBatch]:
        shares, label = _counted(groups, threshold)
        rows = np.flatnonzero(shares)
        ids = groups["first"].combine_chunks()
        if len(rows):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(shares[rows]), ids.take(pa.array(label[rows]))], names=["id", "shares", "near"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        starts = np.flatnonzero(rows["at"].to_numpy() == 1)
        over = int(starts[-1]) if len(starts) else 0
        if over:
            yield from found(rows.slice(0, over))
        held = rows.slice(over)
    if held is not None and held.num_rows:
        yield from found(held)


def close_counts(texts: DataFrame, threshold: float, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, n) and (a, b) for texts (by..., text, first, last), each text of a class once and each ``first`` once: how many texts are close to the text of an id ``first``, and links that join the same ids as all pairs of close texts do.

    Two texts are close when ``block_ratio`` reaches the threshold, the text on the left whose ``first`` is before the other's ``last``.
    Texts that share a form (see ``matching_texts``) are compared where the form's texts lie, and a task leaves a row for each of them: what moves grows with the
    texts, not with the close pairs. A form is shared by no more texts than its letters have places for one letter more. Pairs that share two forms count half
    in each. Pairs of longer texts, which meet on pieces, are listed.
    """
    texts = written(texts.where("text != '' AND first IS NOT NULL"), "borne")
    sides = {x: written(_sized(texts, x, by), "texts") for x in ("left", "right")}
    pairs = lengths_met(sides, threshold, by)
    short = pairs.where(FEW).select(*by, F.col("left_n").alias("n")).distinct()
    formed = texts.withColumn("n", F.length("text")).join(short, [*by, "n"], "left_semi")
    formed = formed.select(*by, "first", F.when(F.col("last") != F.col("first"), F.col("last")).alias("last"), "text", F.explode(_forms(F.col("text"))).alias("form"))
    dealt = formed.repartition(_tasks(texts), *by, "form")
    rows = dealt.withColumn("at", F.row_number().over(Window.partitionBy(*by, "form").orderBy("first"))).select(F.length("form").alias("form_n"), "at", "first", "last", "text")
    near = written(rows.mapInArrow(lambda batches: _counts(batches, threshold), "id string, shares long, near string"), "near")

    likely = _likely(None, sides, pairs, threshold, by).where("left != right")
    side = lambda key, x: texts.select(*by, F.col("text").alias(key), F.col("first").alias(x), F.col("last").alias(f"{x}_last")).hint("merge")
    met = likely.withColumn("ratio", _ratio()("left", "right")).where(F.col("ratio") >= threshold)
    met = met.join(side("left", "x"), [*by, "left"]).join(side("right", "y"), [*by, "right"]).where("x < y_last")
    more = written(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "more")
    ends = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id"))).select("id", F.lit(2).cast("long").alias("shares"))
    n = near.select("id", "shares").unionByName(ends).groupBy("id").agg((F.sum("shares") / 2).cast("long").alias("n"))
    return n, near.where("id != near").select(F.col("near").alias("a"), F.col("id").alias("b")).unionByName(more)


ship(__name__)
