"""Hash embeddings and the bookkeeping of an embedding job."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship

# Size of the local model, and length and stride of its letter groups.
DIMENSIONS, STRIDE, GRAM = 384, 2, 4
TOKEN = re.compile(T.TOKEN)


def _place(feature: str, dimensions: int) -> int:
    """Twice the place of a feature, plus one for a positive sign."""
    d = hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(d[:4], "big") % dimensions * 2 + (d[4] & 1)


def _letter_groups(low: list[str], reach: list[int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text number, group number) of every letter group within each text's reach, and the distinct groups."""
    spots = [np.arange(0, max(0, n - GRAM + 1), STRIDE) for n in reach]
    of = np.repeat(np.arange(len(low)), [len(x) for x in spots])
    if not len(of):
        return of, of, []
    joined = "".join(low)
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *map(len, low[:-1])])
    at = np.concatenate([x + s for x, s in zip(spots, starts)])
    signs, flat = np.unique(flat, return_inverse=True)
    width = np.uint64(max(1, int(len(signs) - 1).bit_length()))
    key = np.zeros(len(at), np.uint64)
    for k in range(GRAM):  # four signs of an alphabet of up to 65,536 fit 64 bits
        key = key << width | flat[at + k].astype(np.uint64)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return of, number, [joined[i : i + GRAM] for i in at[first].tolist()]


def hash_embeddings(texts: list[str], dimensions: int = DIMENSIONS, known: dict[str, int] | None = None, letters: int | None = None) -> np.ndarray:
    """Signed counts of words, word pairs and letter groups in hashed places, a row of length 1 for each text.

    Features are counted over a batch of texts by number, and each distinct one is hashed once; ``known`` keeps the places of
    words between batches. Letter groups reach ``letters`` characters, by default the whole text.
    """
    known = {} if known is None else known
    if len(known) > 500_000:
        known.clear()
    low = [t.lower() for t in texts]
    words = [TOKEN.findall(t) for t in low]
    of = np.repeat(np.arange(len(texts)), list(map(len, words)))
    code, names = pd.factorize(np.array([w for ws in words for w in ws], object)) if len(of) else (of, [])
    one = np.array([known[w] if w in known else known.setdefault(w, _place(w, dimensions)) for w in names], np.int64)
    inside = of[1:] == of[:-1]
    pairs, pair = np.unique(code[:-1][inside] * np.int64(len(names)) + code[1:][inside], return_inverse=True)
    two = np.array([_place(f"{names[x // len(names)]}_{names[x % len(names)]}", dimensions) for x in pairs.tolist()], np.int64)
    reach = [len(t) if letters is None else min(len(t), letters) for t in texts]
    group_of, group, groups = _letter_groups(low, [min(n, len(x)) for n, x in zip(reach, low)])
    three = np.array([_place(f"char:{g}", dimensions) for g in groups], np.int64)
    counts = np.zeros(len(texts) * 2 * dimensions, np.int64)
    for where, places, number in ((of, one, code), (of[1:][inside], two, pair), (group_of, three, group)):
        if len(where):
            counts += np.bincount(where * (2 * dimensions) + places[number], minlength=len(counts))
    grid = counts.reshape(len(texts), dimensions, 2)
    out = (grid[:, :, 1] - grid[:, :, 0]).astype(np.float64)
    n = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, n, out=out, where=n > 0)


def hash_embedding(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    return hash_embeddings([text], dimensions)[0]


def local_provider(dimensions: int = DIMENSIONS) -> Callable[[list[str]], np.ndarray]:
    known: dict[str, int] = {}
    return lambda texts: hash_embeddings(texts, dimensions, known)


def embed(rows: DataFrame, id_col: str, text_col: str, provider: Callable[[list[str]], list] | None = None, batch: int = 256) -> DataFrame:
    """(id, embedding, vector_hash) by a provider that takes lists of texts; the local one needs no network."""
    call = provider or local_provider()
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            vectors = [np.asarray(v, np.float32) for i in range(0, len(texts), batch) for v in call(texts[i : i + batch])]
            if len({len(v) for v in vectors}) > 1:
                raise ValueError("a provider must return vectors of one length")
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": vectors, "vector_hash": [hashlib.sha256(v.tobytes()).hexdigest() for v in vectors]})

    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<float>, vector_hash string")


def hashed_features(rows: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, place, weight) of words by SHA-256, in built-in expressions: the sparse form of a hash embedding."""
    digest = F.sha2("word", 256)
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimensions
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    words = rows.select(id_col, F.explode(T.tokenize(T.text_or_empty(text_col))).alias("word"))
    return words.groupBy(id_col, place.alias("place")).agg(F.sum(sign).alias("weight")).where("weight != 0")


def pending(chunks: DataFrame, embedded: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Chunks without a vector; all of them when forced."""
    return chunks if force else chunks.join(embedded.select(key), key, "left_anti")


def model_id(provider: str, model: str, dimensions: int) -> Column:
    return F.concat_ws(":", F.lit("embed"), T.slug(F.lit(provider)), T.slug(F.lit(model)), F.lit(str(dimensions)))


ship(__name__)
