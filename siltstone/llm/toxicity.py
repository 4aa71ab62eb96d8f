"""Toxicity from a learned lexicon, matched by Levenshtein automata over a trie and read in context.

Learning (rows outside the held-out fold only; at most ``fit_toxic`` toxic and ``fit_clean`` clean documents,
chosen by hash): words and word stems that occur in significantly more toxic documents than clean ones make
the lexicon, the most significant first; a document supports no further term once it holds ``COVER`` chosen
ones, so the words of much-copied documents are not learned for the company they keep. A stem covers every
word that begins with it. Words and stems of ``MIN_FUZZY`` letters are also matched with one edit, of ``MIN_TWO``
with two; from ``MIN_SWAP`` letters two neighbours that change places are one edit. A few general insults are known from the
start at a lower weight, unless clean documents use them.

Scoring: every distinct word of a text is looked up once. Exact words and stems come from sets; any
other word runs through the Levenshtein automaton over the lexicon's trie, which accepts a whole word at its end and
a stem as soon as it is reached. Forms that clean
sample documents contain, of stems the letters that stand for it, are never taken for misspellings. Each
match weighs its evidence, less where it is quoted or reported, more where somebody is addressed. A logistic
curve, fitted on the same sample, turns a text's evidence into its score.

Defined cases: null or empty text has no evidence and gets the curve's base score; a null doc_id is not held
out and never learned from; labels of missing documents and repeated labels do no harm; without labels
the general insults and the default curve are used; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, ship

WORD = re.compile(r"[^\W_]+")
MIN_STEM, MAX_STEM, MIN_SUPPORT = 3, 12, 3
MIN_FUZZY, MIN_SWAP, MIN_TWO, FUZZY = 5, 6, 9, 0.6
MAX_STATES = 10_000
COVER = 3
# General insults known from the start, and their weight.
INSULTS = """bastard clown coward creep disgusting dumb fool garbage idiot idiotic imbecile jerk liar loser lunatic moron
    moronic pathetic pig scum scumbag sleazy slob stupid trash ugly vermin vile worthless""".split()
INSULT_WEIGHT = 3.0
# Words that report speech about a term, and words that address somebody.
REPORTING = frozenset("word words term quote quoted said says called slur insult wrote written".split())
ADDRESS = frozenset("you your youre du dich dein tu te vous votre usted tú".split())
QUOTES = "\"'“”„«»‘’"


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms(word: str) -> list[str]:
    """A word's features: its stems, and itself with an end mark."""
    return [word[:k] for k in range(MIN_STEM, min(len(word), MAX_STEM) + 1)] + [word + "$"]


def _held_terms(wanted: frozenset[str]):
    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"found": [sorted({t for w in set(WORD.findall(x.lower())) for t in terms(w)} & wanted) for x in pdf["text"]]})

    return held


def _count_terms(wanted: frozenset[str] | None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter[str] = Counter()
            for text in pdf["text"]:
                found = {t for w in set(WORD.findall(text.lower())) for t in terms(w)}
                seen.update(found if wanted is None else found & wanted)
            if seen:
                yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    return count


def _tail(hits: int, n: int, rate: float) -> float:
    """Logarithm of the chance of at least ``hits`` among ``n`` at ``rate``."""
    if hits <= n * rate:
        return 0.0
    top = math.lgamma(n + 1) - math.lgamma(hits + 1) - math.lgamma(n - hits + 1)
    log = top + hits * math.log(rate) + (n - hits) * math.log1p(-rate)
    ratio = (n - hits) / (hits + 1) * rate / (1 - rate)
    return min(0.0, log - math.log(max(1e-9, 1 - ratio)))


def significant(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms too frequent in toxic documents to be chance, with the logarithm of that chance."""
    rate = min(0.5, 1.5 * n_toxic / max(1, n_toxic + n_clean))
    level = math.log(0.05 / max(1, len(toxic)))
    out = {}
    for t, n in toxic.items():
        if n / n_toxic > 4 * clean.get(t, 0) / max(1, n_clean) and (tail := _tail(n, n + clean.get(t, 0), rate)) < level:
            out[t] = tail
    return out


def choose(docs: list[list[str]], clean: dict[str, int], n_clean: int) -> dict[str, float]:
    """The lexicon (``$`` marks a whole word) with log-odds, from the significant terms of each toxic document."""
    holders: dict[str, set[int]] = {}
    for i, found in enumerate(docs):
        for t in found:
            holders.setdefault(t, set()).add(i)
    n_toxic = max(1, len(docs))
    rate = min(0.5, 1.5 * n_toxic / max(1, n_toxic + n_clean))
    level = math.log(0.05 / max(1, len(holders)))
    chosen: dict[str, float] = {}
    covered = [0] * len(docs)
    rank = lambda t: (_tail(len(holders[t]), len(holders[t]) + clean.get(t, 0), rate), -len(t), t)
    for t in sorted(holders, key=rank):
        bare = t.rstrip("$")
        if any(bare[:k] in chosen for k in range(MIN_STEM, len(bare) + 1)) or any(c.startswith(bare) for c in chosen):
            continue
        left = sum(covered[i] < COVER for i in holders[t])
        if _tail(left, left + clean.get(t, 0), rate) >= level:
            continue
        odds = (len(holders[t]) + 0.5) / (n_toxic + 1) / ((clean.get(t, 0) + 0.5) / (n_clean + 1))
        chosen[t] = min(8.0, math.log(odds))
        for i in holders[t]:
            covered[i] += 1
    return chosen


class Trie:
    """Lexicon words and stems in a trie, searched by a Levenshtein automaton that is made deterministic as words need it.

    ``bound`` gives the edits allowed for a term. A state of the automaton is a set of (node, edits, letter that a swap
    still awaits, whether letters were swapped); a node is a prefix of a term.
    """

    def __init__(self, words: list[str], stems: list[str] = (), bound: Callable[[str], int] = lambda t: 1) -> None:
        self.words, self.stems = {w: bound(w) for w in words}, {t: bound(t) for t in stems}
        self.reach: dict[str, int] = {"": 0}  # the most edits that a term below a node allows
        self.next: dict[str, str] = {}  # letters that follow a node
        for t, most in [*self.words.items(), *self.stems.items()]:
            for k in range(len(t) + 1):
                self.reach[t[:k]] = max(most, self.reach.get(t[:k], 0))
        for node in sorted(self.reach):
            if node:
                self.next[node[:-1]] = self.next.get(node[:-1], "") + node[-1]
        self.letters = frozenset("".join(self.next.values()))
        self.forget()

    def forget(self) -> None:
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple] = []
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.state({("", 0, "", False)})

    def state(self, items: set[tuple]) -> int:
        """The number of the state that holds ``items`` and what they reach by letters that the word lacks."""
        queue = list(items)
        while queue:
            node, e, wait, swapped = queue.pop()
            if not wait:
                for c in self.next.get(node, ""):
                    item = (node + c, e + 1, "", swapped)
                    if e < self.reach[node + c] and item not in items:
                        items.add(item)
                        queue.append(item)
        key = frozenset(items)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            best = lambda terms: min(
                ((e, n) for n, e, wait, swapped in key if not wait and e <= terms.get(n, -1) and (not swapped or len(n) >= MIN_SWAP)), default=None
            )
            self.ends.append((best(self.words), best(self.stems)))
        return self.numbers[key]

    def step(self, at: int, letter: str) -> int:
        items = set()
        for node, e, wait, swapped in self.sets[at]:
            if wait:
                if letter == wait:
                    items.add((node, e, "", True))
                continue
            if e < self.reach[node]:
                items.add((node, e + 1, "", swapped))  # the word has a letter more
            for c in self.next.get(node, ""):
                child = node + c
                if c == letter:
                    items.add((child, e, "", swapped))
                elif e < self.reach[child]:
                    items.add((child, e + 1, "", swapped))  # another letter stands for c
                    if letter in self.next.get(child, "") and e < self.reach[child + letter]:
                        items.add((child + letter, e + 1, c, True))
        self.steps[at][letter] = to = self.state(items)
        return to

    def match(self, word: str) -> tuple[int, bool, str, int] | None:
        """The nearest term, (edits, is a stem, term, letters read); whole words before stems among equals."""
        if len(self.sets) > MAX_STATES:
            self.forget()
        at, stem = 0, None
        for n, letter in enumerate(word, 1):
            letter = letter if letter in self.letters else ""
            to = self.steps[at].get(letter)
            at = self.step(at, letter) if to is None else to
            if (hit := self.ends[at][1]) is not None and (stem is None or hit[0] < stem[0]):
                stem = *hit, n
            if not self.sets[at]:
                break
        whole = self.ends[at][0]
        if whole is not None and (stem is None or whole[0] <= stem[0]):
            return whole[0], False, whole[1], len(word)
        return None if stem is None else (stem[0], True, *stem[1:])

    def near(self, word: str) -> str | None:
        """A lexicon term within its bound of edits."""
        return (found := self.match(word)) and found[2]


def edits_allowed(term: str) -> int:
    return 0 if len(term) < MIN_FUZZY else 1 if len(term) < MIN_TWO else 2


class Lexicon:
    def __init__(self, weights: dict[str, float], benign: frozenset[str] = frozenset(), curve: tuple[float, float] = (2.0, -2.5)) -> None:
        self.whole = {t[:-1]: w for t, w in weights.items() if t.endswith("$")}
        self.stems = {t: w for t, w in weights.items() if not t.endswith("$")}
        self.lengths = sorted({len(t) for t in self.stems})
        fuzzy = lambda terms: [t for t in terms if len(t) >= MIN_FUZZY]
        self.trie = Trie(fuzzy(self.whole), fuzzy(self.stems), edits_allowed)
        self.benign, self.curve = benign, curve

    def lookup(self, word: str) -> tuple[float, str | None] | None:
        """(weight, misspelled form) of a word in the lexicon; of a stem, the form is the letters that stand for it and a star."""
        if (w := self.whole.get(word)) is not None:
            return w, None
        for k in self.lengths:
            if (w := self.stems.get(word[:k])) is not None and len(word) >= k:
                return w, None
        if word not in self.benign and (found := self.trie.match(word)) is not None:
            edits, is_stem, t, n = found
            form = word[:n] + "*" if is_stem else word
            if form not in self.benign:
                return FUZZY**edits * (self.stems if is_stem else self.whole)[t], form
        return None

    def evidence(self, text: str, known: dict[str, tuple[float, str | None] | None]) -> tuple[float, set[str]]:
        """Evidence in a text, and the misspelled forms in it."""
        low = text.lower()
        hits = {}
        if len(known) > 500_000:
            known.clear()
        for w in set(WORD.findall(low)):
            if w not in known:
                known[w] = self.lookup(w)
            if known[w] is not None:
                hits[w] = known[w]
        if not hits:
            return 0.0, set()
        total = 0.0
        for m in re.finditer(r"(?<![^\W_])(?:" + "|".join(map(re.escape, hits)) + r")(?![^\W_])", low):
            total += hits[m[0]][0] * context(low, m.start(), m.end())
        return total, {odd for _, odd in hits.values() if odd}

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * math.log1p(evidence) + b))))


def context(text: str, start: int, end: int) -> float:
    """Factor of a match: low where it is quoted or reported, high where somebody is addressed."""
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    near = WORD.findall(before)[-5:]
    if before[-1:] and before[-1] in QUOTES and after[:1] and after[0] in QUOTES:
        return 0.15 if REPORTING & set(near) else 0.4
    if REPORTING & set(near):
        return 0.5
    return 1.25 if ADDRESS & set(near + WORD.findall(after)[:3]) else 1.0


def _evidence(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for pdf in batches:
            found = [lexicon.evidence(t, known) for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"].values, "evidence": [e for e, _ in found], "odd": [sorted(o) for _, o in found]})

    return run


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Logistic curve over log(1 + evidence), by Newton's steps with a small ridge."""
    a = np.column_stack([np.log1p(x), np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = 2000, fit_clean: int = 6000) -> Lexicon:
    """Learn the lexicon and the curve from at most ``fit_toxic`` + ``fit_clean`` labelled documents."""
    fold = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [
        fold.where(F.col("toxic") == kind).select("doc_id").distinct().orderBy(*order).limit(most).withColumn("toxic", F.lit(kind))
        for kind, most in ((1, fit_toxic), (0, fit_clean))
    ]
    ids = [(r[0], r[1]) for r in picked[0].union(picked[1]).collect()]
    if not ids:
        return Lexicon({w + "$": INSULT_WEIGHT for w in INSULTS})
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    sample = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text").persist()  # bounded by the two limits
    try:
        counted = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
        tally = lambda df, wanted=None: df.mapInPandas(_count_terms(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        toxic = {r[0]: r[1] for r in tally(sample.where("toxic = 1")).where(F.col("n") >= MIN_SUPPORT).collect()}
        clean = {r[0]: r[1] for r in tally(sample.where("toxic = 0"), frozenset(toxic)).collect()} if toxic else {}
        good = frozenset(significant(toxic, clean, max(1, counted.get(1, 0)), counted.get(0, 0)))
        found = sample.where("toxic = 1").mapInPandas(_held_terms(good), "found array<string>").collect() if good else []
        weights = choose([r[0] for r in found], clean, counted.get(0, 0))
        insults = frozenset(w + "$" for w in INSULTS)
        used = {r[0] for r in tally(sample.where("toxic = 0"), insults).collect()}
        weights = dict.fromkeys(insults - used, INSULT_WEIGHT) | weights
        rows = sample.mapInPandas(_evidence(Lexicon(weights)), "toxic int, evidence double, odd array<string>").collect()
        benign = frozenset(w for r in rows if r.toxic == 0 for w in r.odd)
        rows = sample.mapInPandas(_evidence(Lexicon(weights, benign)), "toxic int, evidence double, odd array<string>").collect() if benign else rows
        curve = _fit_curve(np.array([r.evidence for r in rows]), np.array([r.toxic for r in rows], float))
    finally:
        sample.unpersist()
    return Lexicon(weights, benign, curve)


def _scorer(lexicon: Lexicon, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for pdf in batches:
            scores = np.array([lexicon.score(lexicon.evidence(t, known)[0]) for t in pdf["text"]], float)
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"].values, "held_out": pdf["held_out"].values, "score": scores, "predicted": (scores >= threshold).astype(np.int32)}
            )

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text isn't predicted toxic; each row by its own text."""
    rows = columns(docs, doc_id="doc_id", text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lexicon = fit(rows, columns(labels, doc_id="doc_id", toxic="toxic"))

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for texts in batches:
            yield pd.Series([lexicon.score(lexicon.evidence(t, known)[0]) < threshold for t in texts], dtype=bool)

    judge = F.pandas_udf(clean, "boolean")
    return docs.where(judge(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
    fit_toxic: int = 2000,
    fit_clean: int = 6000,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lexicon = fit(rows, columns(labels, doc_id="doc_id", toxic="toxic"), fit_toxic, fit_clean)
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInPandas(
        _scorer(lexicon, threshold), "doc_id long, held_out boolean, score double, predicted int"
    )


ship(__name__)
