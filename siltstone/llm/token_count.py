"""Token counts of a unigram vocabulary by a count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches in a text; dynamic programming keeps, for each
position, the best score of a path that ends there and that path's number of pieces - no path, no pieces.
Ties follow the tokenizers library: among equal scores the piece that starts first stays. A character that is
no piece costs the least score minus 10 and counts its UTF-8 bytes (byte fallback).

Spaces become the word mark and a text starts with one. Where no piece has the mark after another character
and all scores are whole numbers, a text is the sum of its words, so each distinct word is counted once
by each task and kept in a bounded memory.

Defined cases: null or empty text has no tokens; rows with one doc_id or a null one are rows of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, ship

MARK, PENALTY = "▁", 10.0


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        whole = all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p, _ in vocabulary) and all(float(s).is_integer() for _, s in vocabulary)
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if whole else "(?s).+")
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Pieces of the best segmentation."""
        ending: dict[int, list[tuple[int, float]]] = {}
        for end, match in self.automaton.iter(text):  # at one end from the longest match to the shortest
            ending.setdefault(end + 1, []).append(match)
        score, count = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        for stop in range(1, len(text) + 1):
            best, pieces, single = None, 0, False
            for size, s in ending.get(stop, ()):
                if best is None or s + score[stop - size] > best:
                    best, pieces = s + score[stop - size], count[stop - size] + 1
                single = single or size == 1
            if not single and (best is None or self.unknown + score[stop - 1] > best):
                best, pieces = self.unknown + score[stop - 1], count[stop - 1] + len(text[stop - 1].encode("utf-8", "surrogatepass"))
            score[stop], count[stop] = best, pieces
        return count[-1]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        text = text if text.startswith(MARK) else MARK + text
        known, total = self.known, 0
        for w in self.words.findall(text):
            n = known.get(w)
            if n is None:
                if len(known) > 1_000_000:
                    known.clear()
                n = known[w] = self.viterbi(w)
            total += n
        return total


def unigram_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


def _counter(vocabulary: list[tuple[str, float]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counter(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": pdf["text"].str.len(), "n_tokens": [count(t) for t in pdf["text"]]})

    return run


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, n_tokens. The vocabulary goes to the tasks with the function."""
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.mapInPandas(_counter(vocabulary), f"doc_id {dict(rows.dtypes)['doc_id']}, n_chars long, n_tokens long")


ship(__name__)
