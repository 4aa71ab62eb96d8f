"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file lists byte strings by rank; two neighbours merge when their union is listed, lowest rank first, leftmost first.
The library wants pairs instead. The pair of a token is found by merging its own bytes with the ranks below its own: what
is left are the two neighbours that can ever form it, because merges inside a stretch of bytes whose borders no merge has
crossed go the same way wherever the stretch stands. Tokens that leave more than two parts are never formed by a merge;
they are ids of whole words only (``ignore_merges``).

Bytes become the characters of the byte-level alphabet (``byte_alphabet``); decoding reverses that table, joins the bytes
of all pieces and only then reads characters, so characters that are split over tokens come back whole. Offsets count code
points; tokens that hold part of a character have the whole character's place.

Words are cut by the pattern with a faster library; texts with a code point that the two libraries put in different classes, as their
Unicode versions differ, are cut by the tokenizers library itself (``unsure_points``; a test covers all code points). A task keeps the ids of words it has met, up to ``KNOWN_CHARS`` letters, and hands the others of a stretch of texts to the library together.
Nothing is shuffled. A task holds one Arrow batch (at most a thousand rows) and encodes at most ``BATCH_CHARS`` characters at
a time, or one longer text. Broadcasts: the tokenizer's file, whose size doesn't depend on the data.

Defined cases: null text is empty and has no tokens; rows with one id or a null one are rows of their own; an empty table
gives no rows; other columns are not looked at. Decoding: null ids and ids that the vocabulary lacks add nothing; bytes that
are no characters read as U+FFFD in ``text`` and stay as they are in ``decoded``.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, columns, ship

BATCH_CHARS, KNOWN_CHARS = 1 << 18, 3_000_000


def byte_alphabet() -> dict[int, str]:
    """The character of each byte: printable Latin-1 stands for itself, the other bytes follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged_below(ranks: dict[bytes, int], token: bytes) -> list[bytes]:
    """What is left of a token's bytes after all merges of lower rank."""
    limit = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def tokenizer_spec(ranks: dict[bytes, int]) -> str:
    """The library's tokenizer of words for a rank file, as JSON. Ranks are the ids; all 256 bytes must be listed."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the rank file lacks the bytes {lacking}")
    alphabet = byte_alphabet()
    spelled = {token: "".join(alphabet[b] for b in token) for token in ranks}
    pairs = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        parts = merged_below(ranks, token)
        if len(parts) == 2:
            pairs.append((spelled[parts[0]], spelled[parts[1]]))
    tok = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=pairs, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok.to_str()


def load(spec: str, pattern: str | None = None):
    """The tokenizer of a task, of words or with a pattern of texts, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    tok = Tokenizer.from_str(spec)
    if pattern is not None:
        tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), tok.pre_tokenizer])
    return tok


def unsure_points(pattern: str) -> str:
    """The code points that the two libraries put in different classes of the pattern, as a character class; empty where there are none."""
    import regex
    from tokenizers import Regex, pre_tokenizers

    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    unsure: set[str] = set()
    for kind in dict.fromkeys(regex.findall(r"\\[pP]\{\w+\}|\\[swdSWD]", pattern)):
        runs = pre_tokenizers.Split(Regex(f"[^{kind}]+"), "removed").pre_tokenize_str(points)
        unsure |= set().union(*(r for r, _ in runs)) ^ set().union(*regex.findall(f"{kind}+", points))
    runs, listed = [], sorted(map(ord, unsure))
    for i, c in enumerate(listed):
        if i and c == listed[i - 1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return f"[{''.join(f'\\U{a:08x}-\\U{b:08x}' for a, b in runs)}]" if runs else ""


def byte_pieces(tok) -> list[bytes]:
    """The bytes of each id, by the reversed alphabet."""
    of = {c: b for b, c in byte_alphabet().items()}
    vocab = tok.get_vocab()
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        pieces[i] = bytes(of[c] for c in piece)
    return pieces


def char_offsets(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) code point of consecutive pieces of ``sizes`` bytes each."""
    char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``BATCH_CHARS`` characters, or one longer text."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > BATCH_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if texts:
        yield start, len(texts)


class Encoder:
    """Ids of texts; the words of a stretch of texts that are not known yet go to the library in one call."""

    def __init__(self, spec: str, pattern: str, unsure: str) -> None:
        import regex

        self.tok, self.words, self.whole = load(spec), regex.compile(pattern), load(spec, pattern)
        self.unsure = regex.compile(unsure) if unsure else None
        self.size = np.array([len(p) for p in byte_pieces(self.tok)])
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def learn(self, words: list[str]) -> None:
        """Keep the ids of words. Pieces never reach over two words, so the words' bytes say where each one's ids end."""
        found = self.tok.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, np.int32)
        last = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w.encode()) for w in words]))
        ends, raw = (4 * (last + 1)).tolist(), ids.tobytes()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends))))
        self.chars += sum(map(len, words))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        odd = [self.unsure is not None and not t.isascii() and self.unsure.search(t) is not None for t in texts]
        cut = [[] if o else self.words.findall(t) for t, o in zip(texts, odd)]
        if self.chars > KNOWN_CHARS:
            self.known, self.chars = {}, 0
        if new := set().union(*cut).difference(self.known):
            self.learn(list(new))
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in cut]
        for i in np.flatnonzero(odd):
            ids[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return ids


def lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list of int32 for each array."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _encode(spec: str, pattern: str, unsure: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec, pattern, unsure)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, stop in stretches(texts):
                some = texts[start:stop]
                ids = encoder(some)
                places = [char_offsets(t.encode(), encoder.size[i]) for t, i in zip(some, ids)]
                split = [int((first[1:] < end[:-1]).sum()) for first, end in places]
                found = [batch.column("doc_id").slice(start, stop - start), lists(ids), pa.array(split, pa.int64())]
                names = ["doc_id", "ids", "n_split"]
                if offsets:
                    found += [lists([p[0] for p in places]), lists([p[1] for p in places])]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(found, names=names)

    return run


def encode(docs: DataFrame, spec: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """doc_id, ids, n_split (neighbours that share a character) and, with ``offsets``, starts and ends in code points."""
    arrow_rows(docs.sparkSession, 1000)
    rows = columns(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    places = ", starts array<int>, ends array<int>" if offsets else ""
    return rows.mapInArrow(_encode(spec, pattern, unsure_points(pattern), offsets), f"doc_id {kind}, ids array<int>, n_split long{places}")


def _decode(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = byte_pieces(load(spec))
        pieces = pa.array(listed, pa.large_binary())
        for batch in batches:
            ids = batch.column("_ids")
            raw = []
            for row in range(len(batch)):
                own = ids[row].values
                if own is None or not len(own):
                    raw.append(b"")
                    continue
                known = pc.and_(pc.greater_equal(own, 0), pc.less(own, len(listed)))
                taken = pieces.take(own.filter(known))
                at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
                raw.append(bytes(memoryview(taken.buffers()[2] or b"")[at[0] : at[-1]]))
            text = pa.array([b.decode("utf-8", "replace") for b in raw], pa.string())
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(raw, pa.binary()), text], names=[*batch.schema.names[:-1], "decoded", "decoded_text"])

    return run


def decode(rows: DataFrame, spec: str, ids_col: str = "ids") -> DataFrame:
    """All columns but ``ids_col``, with decoded (bytes) and decoded_text in its place."""
    kept = [c for c in rows.columns if c not in (ids_col, "decoded", "decoded_text")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    found = rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids_col}`").alias("_ids"))
    return found.mapInArrow(_decode(spec), f"{schema + ', ' if kept else ''}decoded binary, decoded_text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes that they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256, n_split."""
    spec = tokenizer_spec(load_ranks(ranks_path))
    rows = encode(docs, spec, pattern, id_col, text_col, offsets=False)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    coded = rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), "n_split", "ids")
    return decode(coded, spec).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


ship(__name__)
