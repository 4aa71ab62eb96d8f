"""Personal data: four base patterns, and a semi-Markov conditional random field that adds spans.

Base spans are leftmost non-overlapping matches of one pattern for each kind, checked and dropped as a
whole when a check fails. The random field works on the text between base spans: windows around digits and
at-signs are cut into atoms, every run of at most ``MAX_ATOMS`` atoms is a candidate segment with features of
the whole span (digits, Luhn sum, octets, separators, spelled-out signs, the word before), and a dynamic
program over segments chooses boundaries and kinds jointly. Only segments whose score beats "no entity" by
``MARGIN`` are added. What the field can see: a window reaches ``REACH`` characters to each side of a trigger (at least six digits
with little between them, an at-sign, a spelled-out one), and a candidate has at least ``LEAST`` characters, as no number or
address of the four kinds is shorter.

The field is trained in place: base spans of a bounded sample of documents (``fit_docs``, ``fit_windows``) are
its gold segments, also in spellings that the patterns miss (a missing plus sign, "at" and "dot", bracketed
dots). Everything else in the sample is text without entities.

Defined cases: null text is empty and has no spans; rows with one doc_id are rows of their own; without any
sample (no digits or at-signs, an empty table) the field adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, ship

# The base patterns of the contract, by kind.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
TRIGGER = re.compile(r"@|[0-9](?:[\x20()./\[\]-]{0,3}[0-9]){5,}|[\[(]at[\])]|\bat [a-z0-9-]+ (?:dot|\[dot\]) ", re.I)
# An address with its signs, or with words or brackets in their place; what joins a name's parts before and after a span.
_DOT = r"(?: ?(?:\.|\[\.\]|\[dot\]|\(dot\)) ?| dot )"
ADDRESS = re.compile(rf"[a-z0-9_%+-]+(?:{_DOT}[a-z0-9_%+-]+)*(?: ?(?:@|\[at\]|\(at\)) ?| at )[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+")
NAME_AFTER = re.compile(rf"{_DOT}[A-Za-z0-9]", re.I)
NAME_BEFORE = re.compile(rf"[A-Za-z0-9](?:{_DOT}|[_%+-])\Z", re.I)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
MAX_ATOMS, REACH, LEAST, MARGIN = 24, 48, 7, 2.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start and kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # a match's local part is the run before its at-sign, cut where the last match ended
        left = max(done, at - 64)
        while (run := LOCAL.search(text[left:at]).start()) == 0 and left > done:
            left = max(done, left - 4096)
        m = EMAIL.match(text, left + run)
        if m and m.start() < at < m.end():
            out.append((m.start(), m.end(), 0))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted((s, e, k) for s, e, k in out)


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


# Words before a span that hint at its kind.
HINTS = {"mail": "email", "email": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "card": "card",
         "visa": "card", "credit": "card", "phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone"}


def features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate span."""
    span = text[start:end]
    d = _digits(span)
    low = span.lower()
    letters = re.sub(r"[^a-z]", "", low)
    dots = re.split(r"\.|\[\.\]|\(\.\)", span)
    signs = re.sub(r"[0-9A-Za-z\s]", "", span)
    out = ["bias", f"digits{len(d) if len(d) < 20 else 20}", f"first{_shape(span[0])}", f"last{_shape(span[-1])}"]
    if not letters:
        out.append("nolet")
        if len(dots) == 4 and all(p.isdigit() and _small(p) for p in dots):
            out.append("octets")
        if 14 <= len(d) <= 19:
            out.append("luhn" if luhn(d) else "noluhn")
        if re.fullmatch(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-]?[0-9]{2,8}", span):
            out.append("dialled")
        if len(set(signs)) <= 1:
            out.append("onesign")
        if re.fullmatch(r"[0-9]{4}([ ./-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}", span):
            out.append("fours")
    else:
        out.append("letters")
        if ADDRESS.fullmatch(low):
            out.append("address")
        if NAME_AFTER.match(text[end : end + 8]):
            out.append("name-goes-on")
        if NAME_BEFORE.search(text[max(0, start - 8) : start]):
            out.append("name-began")
    if re.search(r"[0-9)][ .-]?\(?\Z", text[max(0, start - 3) : start]):
        out.append("number-began")
    if re.match(r"[ .-]?\(?[0-9]", text[end : end + 3]):
        out.append("number-goes-on")
    if span.count("(") != span.count(")") or span.count("[") != span.count("]"):
        out.append("unpaired")
    word = re.search(r"([A-Za-z]+)[\s:=#]*\Z", text[max(0, start - 24) : start])
    if word and word[1].lower() in HINTS:
        out.append("hint-" + HINTS[word[1].lower()])
    for side, c in (("left", text[start - 1 : start]), ("right", text[end : end + 1])):
        if c and (c.isalnum() or c in "@+"):
            out.append(f"cut{side}")
        if c and c in ".-/" and (side == "left" or text[end + 1 : end + 2].isdigit()):
            out.append(f"goes-on-{side}")
    return out


def _shape(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.isalpha() else c


def candidates(text: str) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of atoms, and the candidate segments (first atom, end atom, start, end) of a window."""
    atoms = [(m.start(), m.end()) for m in ATOM.finditer(text)]
    out = []
    for i, (start, _) in enumerate(atoms):
        if text[start] not in "+([" and not text[start].isalnum():
            continue
        for j in range(i, min(i + MAX_ATOMS, len(atoms))):
            if j > i and atoms[j][0] - atoms[j - 1][1] > 1:
                break
            end = atoms[j][1]
            if not (text[end - 1].isalnum()) or end - start < LEAST:
                continue
            span = text[start:end]
            if sum(c.isdigit() for c in span) >= 4 or "@" in span or "at" in span.lower() and ("dot" in span.lower() or "." in span):
                out.append((i, j + 1, start, end))
    return len(atoms), out


class Taken:
    """Base spans, for questions about what lies where; each is answered by search over their sorted borders."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts = [s for s, _, _ in self.spans]
        self.ends = sorted(e for _, e, _ in self.spans)
        self.reach = list(accumulate((e for _, e, _ in self.spans), max))  # how far the spans up to here go

    def meets(self, start: int, end: int) -> bool:
        """Whether a span overlaps a stretch."""
        return bisect_left(self.starts, end) > bisect_right(self.ends, start)

    def covered(self, start: int, end: int) -> int:
        """Characters of a stretch that spans cover, each span for itself."""
        out, i = 0, bisect_left(self.starts, end) - 1
        while i >= 0 and self.reach[i] > start:
            s, e, _ = self.spans[i]
            out += max(0, min(e, end) - max(s, start))
            i -= 1
        return out

    def room(self, start: int, end: int, lo: int, hi: int) -> tuple[int, int]:
        """[lo, hi) cut at the nearest span that ends before a stretch and the nearest that starts after it."""
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        lo = max(lo, self.ends[before - 1]) if before else lo
        return lo, min(hi, self.starts[after]) if after < len(self.starts) else hi


def windows(text: str, taken: Taken) -> list[tuple[int, int]]:
    """Stretches between base spans that hold a trigger, joined where they touch."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        start, end = m.span()
        if taken.meets(start, end) and end - start - taken.covered(start, end) < LEAST:
            continue
        lo, hi = taken.room(start, end, max(0, start - REACH), min(len(text), end + REACH))
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class Field:
    """A semi-Markov conditional random field over candidate segments of a window."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = weights

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in feats]).reshape(-1, len(KINDS))

    def best(self, text: str, margin: float = MARGIN) -> list[tuple[int, int, int]]:
        """The best segmentation's spans (start, end, kind) in a window."""
        n, segs = candidates(text)
        if not segs or not self.weights:
            return []
        s = np.concatenate([self.scores([features(text, a, b) for _, _, a, b in segs[at : at + 4096]]) for at in range(0, len(segs), 4096)]) - margin
        ending: dict[int, list[int]] = {}
        for x, (_, j, _, _) in enumerate(segs):
            ending.setdefault(j, []).append(x)
        top, back = np.zeros(n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for x in ending.get(j, ()):
                if (v := top[segs[x][0]] + s[x].max()) > top[j]:
                    top[j], back[j] = v, x
        out, j = [], n
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                i, _, a, b = segs[back[j]]
                out.append((a, b, int(s[back[j]].argmax())))
                j = i
        return out[::-1]

    @classmethod
    def fit(cls, cases: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 12, rate: float = 0.2, ridge: float = 1e-3) -> Field:
        """Gradient ascent on the conditional likelihood; ``cases`` are windows with their gold spans."""
        names: dict[str, int] = {}
        prepared = []
        for text, gold in cases:
            n, segs = candidates(text)
            if not segs:
                continue
            found = [[names.setdefault(f, len(names)) for f in features(text, a, b)] for _, _, a, b in segs]
            want = {(a, b): k for a, b, k in gold}
            flat, cuts = np.array([i for fs in found for i in fs]), np.cumsum([0, *map(len, found)])
            prepared.append((n, segs, flat, cuts, [want.get((a, b), -1) for _, _, a, b in segs]))
        w = np.zeros((len(names), len(KINDS)))
        for _ in range(epochs):
            for n, segs, flat, cuts, gold in prepared:
                s = np.add.reduceat(w[flat], cuts[:-1])
                each = np.logaddexp.reduce(s, axis=1).tolist()
                fwd, bwd = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
                ending, starting = {}, {}
                for x, (i, j, _, _) in enumerate(segs):
                    ending.setdefault(j, []).append((i, each[x]))
                    starting.setdefault(i, []).append((j, each[x]))
                for j in range(1, n + 1):
                    fwd[j] = _log_sum([fwd[j - 1], *(fwd[i] + e for i, e in ending.get(j, ()))])
                for i in range(n - 1, -1, -1):
                    bwd[i] = _log_sum([bwd[i + 1], *(bwd[j] + e for j, e in starting.get(i, ()))])
                outside = np.array([fwd[i] + bwd[j] - fwd[n] for i, j, _, _ in segs])
                step = -np.exp(outside[:, None] + s)
                for x, k in enumerate(gold):
                    if k >= 0:
                        step[x, k] += 1
                np.add.at(w, flat, rate * np.repeat(step, np.diff(cuts), axis=0))
                w[np.unique(flat)] *= 1 - rate * ridge
        return cls({f: w[i] for f, i in names.items()})


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def respell(text: str, gold: list[tuple[int, int, int]], turn: int) -> tuple[str, list[tuple[int, int, int]]]:
    """A window whose entities are spelled in a way that the base patterns miss."""
    out, at, spans = [], 0, []
    done = 0
    for s, e, k in sorted(gold):
        if s < at:
            continue
        span = text[s:e]
        if k == 0:
            span = span.replace("@", (" at ", "[at]", "(at)")[turn % 3]).replace(".", (" dot ", ".", "[dot]")[turn % 3])
        elif k == 1:
            span = span.replace(".", ("[.]", "(.)", ".")[turn % 3])
        elif k == 2 and " " not in span and "-" not in span:
            span = ("/", ".", "")[turn % 3].join(span[i : i + 4] for i in range(0, len(span), 4))
        elif k == 3:
            span = span.lstrip("+") if turn % 3 else span
        out.append(text[at:s])
        done += s - at
        spans.append((done, done + len(span), k))
        out.append(span)
        done += len(span)
        at = e
    out.append(text[at:])
    return "".join(out), spans


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of sampled documents, with base spans left in."""
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            for s, e in windows(text, Taken([])):
                rows.append((doc_id, s, text[s:e]))
        yield pd.DataFrame(rows, columns=["doc_id", "start", "window"])


def fit(docs: DataFrame, fit_docs: int = 600, fit_windows: int = 500) -> Field:
    """Train on at most ``fit_windows`` windows of at most ``fit_docs`` documents, chosen by hash."""
    some = docs.where(F.col("text").rlike("[0-9]{3}|@") & F.col("doc_id").isNotNull())
    ids = [r[0] for r in some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs).collect()]
    rows = (
        some.where(F.col("doc_id").isin(ids))
        .mapInPandas(_sample, "doc_id long, start long, window string")
        .orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start")
        .limit(fit_windows)
        .collect()
        if ids
        else []
    )
    cases = []
    for turn, r in enumerate(rows):
        gold = base_spans(r.window)
        cases.append((r.window, gold))
        if gold:
            cases.append(respell(r.window, gold, turn))
    return Field.fit(cases)


def _finder(field: Field):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base = base_spans(text)
                added, taken = [], Taken(base)
                for lo, hi in windows(text, taken):
                    for s, e, k in field.best(text[lo:hi]):
                        s, e = s + lo, e + lo
                        if not taken.meets(s, e):
                            added.append((s, e, k))
                spans = base + added
                counts = [sum(k == kind for _, _, k in of) for of in (spans, base) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(spans), len(added)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), *(f"base_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
            out.insert(0, "id", pdf["id"].values)
            yield out

    return find


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = 600, fit_windows: int = 500) -> DataFrame:
    """One row per document: doc_id, counts of all spans by kind, counts of base spans by kind, base_sha256, spans (code points, end exclusive), n_added."""
    rows = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = ", ".join(f"{what}_{k} long" for what in ("n", "base") for k in KINDS)
    found = rows.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(  # pandas would make floats of ids beside a null
        _finder(fit(rows, fit_docs, fit_windows)), f"id string, {counts}, base_sha256 string, spans string, n_added long"
    )
    return found.select(F.col("id").cast("long").alias("doc_id"), *found.columns[1:])


ship(__name__)
