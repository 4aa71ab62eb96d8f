"""Prefix trie, byte-level encoding and hard negatives against plain versions."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import byte_level, hard_negatives, prefix_trie, queries
from siltstone.llm.common import tokenizer_file

DATA = "/root/testdata/sf0.001"
CLASHING = "chain key at block first copies lcp n v a ids kind label text vec q list far times rank".split()


# --- 11 prefix trie --------------------------------------------------------------------------------------------


def rebuilt_plain(rows, branch):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    if not branch:
        return turns
    out = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    return out


def trie_plain(rows, branch=True):
    turns = rebuilt_plain(rows, branch)
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                kids[tuple(v[: d - 1])].add(tuple(v[:d]))
    saved, leaves = collections.Counter(), collections.Counter()
    for path, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * words
            leaves[path[:d]] += path not in kids
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(turns[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), parent, len(m), len(kids.get(path, ())), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows, branch=True, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, branch).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_trie_equals_plain_trie(spark, monkeypatch, seed, block):
    """Blocks of one row up to all rows: nodes that lie in one block, that reach over several, and that end with the table."""
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-30, 400), rnd.choice([3, 40, 120])):
        rows += [(c, t, rnd.choice(["u", "a"]), rnd.choice(["x y", "", "z"])) for t in range(rnd.choice([1, 2, 4, 9]))]
    rnd.shuffle(rows)
    assert trie_of(spark, rows, seed % 2 == 0) == trie_plain(rows, seed % 2 == 0)


AWKWARD_TURNS = [
    (1, None, "u", "before all"), (1, 0, None, None), (1, 0, None, None), (1, 1, "u", "tie b"), (1, 1, "u", "tie a"),
    (2, 0, "ab", "c"), (3, 0, "a", "bc"), (4, 5, "u", "w " * 40_000), (None, 0, "u", "no conversation"), (20, 0, "", ""),
    (40, 0, "u", "😀 é"), (41, 0, "u", "😀 é"), (-20, 1, "u", "x"), (-19, 1, "u", "x"), (7, 3, "u", None),
]


@pytest.mark.parametrize("branch", [True, False])
def test_trie_of_awkward_turns(spark, branch):
    assert trie_of(spark, AWKWARD_TURNS, branch, extra=True) == trie_plain(AWKWARD_TURNS, branch)


def test_trie_of_no_turns_and_of_one(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "u", "x")]) == []
    assert trie_of(spark, [(5, 1, "u", "x y")], False) == trie_plain([(5, 1, "u", "x y")], False)
    # one turn whose place another conversation would fill that isn't there: nothing is left but the root
    alone = next(c for c in range(1, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    assert [r[:4] for r in trie_of(spark, [(alone, 1, "u", "x")])] == [(alone, 0, None, 1)]


def test_trie_of_copies_of_one_conversation_and_of_long_ones(spark):
    """A third of all rows is one conversation; another has a thousand turns, and one ends inside it."""
    rows = [(c, t, "u", f"same {t}") for c in range(300) for t in range(3)]
    rows += [(1000, t, "u", f"long {t}") for t in range(1000)] + [(1001, t, "u", f"long {t}") for t in range(400)]
    got = trie_of(spark, rows, False)
    assert got == trie_plain(rows, False)
    assert max(r[1] for r in got) == 1000


def test_trie_query_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_prefix_trie(spark, DATA).collect()), key=str)
    assert got == trie_plain(rows)


def test_nearest_smaller_values_equal_a_scan():
    rnd = random.Random(5)
    for _ in range(200):
        v = [rnd.randrange(4) for _ in range(rnd.randrange(1, 12))]
        before, after = prefix_trie.nearest_smaller(np.array(v))
        assert before.tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
        assert after.tolist() == [min((j for j in range(i + 1, len(v)) if v[j] < v[i]), default=len(v)) for i in range(len(v))]


# --- 12 byte-level encoding ------------------------------------------------------------------------------------

TEXTS = ["", None, "plain text", "é", "😀😀 漢字", "á zero‍width", "tab\tnew\n\n  line", "word" * 5000, "x" * 20_000, " " * 999, "<|endoftext|> 'll we've", "ſ ǅ ٣ Ⅷ \x00\x1f\x85"]


@pytest.fixture(scope="module")
def spec():
    return byte_level.tokenizer_spec(byte_level.load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken")))


@pytest.fixture(scope="module")
def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def other():
    import public_tokenizers
    import tiktoken

    ranks = byte_level.load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_level_query_equals_the_other_library(spark, other):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op12_byte_level(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = other.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_byte_level_of_awkward_texts(spark, spec, pattern, other):
    df = spark.createDataFrame([(None if i == 3 else i // 2, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    df = df.select("*", *(F.lit("x").alias(c) for c in ("ids", "starts", "ends", "decoded", "n_split")))
    rows = byte_level.encode(df, spec, pattern)
    got = byte_level.decode(rows, spec).collect()
    assert len(got) == len(TEXTS)
    want = collections.Counter((None if i == 3 else i // 2, t or "") for i, t in enumerate(TEXTS))
    assert collections.Counter((r.doc_id, r.decoded_text) for r in got) == want
    by_text = {r.decoded_text: r for r in got}
    ids = {tuple(r.ids) for r in rows.collect()}
    assert ids == {tuple(other.encode_ordinary(t or "")) for t in TEXTS}
    assert by_text[""].starts == [] and byte_level.encode(df.where("false"), spec, pattern).count() == 0


def test_offsets_cover_the_text_and_split_characters(spark, spec, pattern, other):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in byte_level.encode(df, spec, pattern).collect():
        text = TEXTS[r.doc_id] or ""
        parts = [other.decode_single_token_bytes(i) for i in r.ids]
        at, split = 0, 0
        for part, start, end in zip(parts, r.starts, r.ends):
            first = len(text.encode()[:at].decode("utf-8", "ignore"))
            last = len(text.encode()[: at + len(part)].decode("utf-8", "ignore"))
            whole = text.encode()[: at + len(part)].decode("utf-8", "replace")
            assert start == first and end == max(last, len(whole))
            at += len(part)
        split = sum(s < e for s, e in zip(r.starts[1:], r.ends[:-1]))
        assert at == len(text.encode()) and r.n_split == split
    assert byte_level.encode(df.where("doc_id = 4"), spec, pattern).first().n_split > 0


def test_decoding_skips_what_is_no_id_and_keeps_broken_bytes(spark, spec, other):
    half = other.encode_ordinary("漢")
    df = spark.createDataFrame([(1, [-1, 10**9, None, *other.encode_ordinary("ok")]), (2, None), (3, []), (4, half[:1])], "k long, ids array<long>")
    got = {r.k: r for r in byte_level.decode(df.withColumn("ids", F.col("ids").cast("array<int>")), spec).collect()}
    assert got[1].decoded_text == "ok" and got[2].decoded == b"" and got[3].decoded_text == ""
    whole = b"".join(other.decode_single_token_bytes(i) for i in half[:1])
    assert bytes(got[4].decoded) == whole and got[4].decoded_text == whole.decode("utf-8", "replace")


def test_random_strings_encode_alike(monkeypatch, spec, pattern, other):
    monkeypatch.setattr(byte_level, "KNOWN_CHARS", 2000)
    encoder = byte_level.Encoder(spec, pattern, byte_level.unsure_points(pattern))
    rnd = random.Random(11)
    alphabet = "aaabbc  \n\t.,'slt1é漢😀́ſ" + "".join(chr(rnd.randrange(0x20, 0xD7FF)) for _ in range(200))
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    for start in range(0, len(texts), 100):
        some = texts[start : start + 100]
        assert [ids.tolist() for ids in encoder(some)] == [other.encode_ordinary(t) for t in some]


def test_all_code_points_are_cut_alike(spec, pattern, other):
    """Letters, numbers and spaces are the same to the pattern's library and to the rank library, between all kinds of neighbours."""
    encoder = byte_level.Encoder(spec, pattern, byte_level.unsure_points(pattern))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 4096):
        some = [(c := chr(p)) and f"a{c}a {c}1{c} {c}\n{c}.{c}{c}  {c}" for p in points[start : start + 4096]]
        assert [ids.tolist() for ids in encoder(some)] == other.encode_ordinary_batch(some, num_threads=4)


def test_pairs_of_small_rank_files_merge_like_ranks():
    """Tokens that no two parts form are ids of whole words only."""
    import tiktoken

    letters = {bytes([b]): b for b in range(256)}
    ranks = letters | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259, b"abab": 260, b"xyz": 261, b"aa": 262, b"aaa": 263, b"aaaa": 264}
    encoder = byte_level.Encoder(byte_level.tokenizer_spec(ranks), r"\S+|\s+", "")
    other = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcxyz ") for _ in range(rnd.randrange(14))) for _ in range(3000)]
    assert [ids.tolist() for ids in encoder(texts)] == [other.encode_ordinary(t) for t in texts]
    with pytest.raises(ValueError):
        byte_level.tokenizer_spec({b"a": 0})


def test_rank_file_is_read_by_line(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate([b"a", b"ab"])) + b"\n\n")
    assert byte_level.load_ranks(str(path)) == {b"a": 0, b"ab": 1}


# --- 13 hard negatives -----------------------------------------------------------------------------------------


def negatives_plain(rows, every=50, low=50, high=95):
    """All pairs, by row; rows that agree in id, vector and label count once."""
    width = max((len(v) for _, v, _ in rows if v), default=0)
    used = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v) + (0,) * (width - len(v))))
    out = []
    for a in used:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in used if b is not a)
        for p, pid, label in [s for s in scored if s[2] == a[1]][:5]:
            fits = [s for s in scored if s[2] != a[1] and low * -p <= 100 * -s[0] <= high * -p][:3]
            out += [(a[0], pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


def negatives_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c != "label"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())


def clustered(seed, n, dim=6):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(7, dim))
    return [(i, [float(x) for x in (centers[i % 7] + rnd.normal(size=dim) * 0.3) / 2], int(rnd.integers(3))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "LIST_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK", 5)
    monkeypatch.setattr(hard_negatives, "HELD", 90)
    rows = clustered(seed, 900)
    assert negatives_of(spark, rows) == negatives_plain(rows)


def test_negatives_of_awkward_rows(spark):
    """Nulls, other lengths, ties, a vector that a third of the rows share, repeated rows and ids, non-finite components."""
    rows = [(i, [0.5, 0.25], i % 2) for i in range(0, 400)]
    rows += [(i, [0.5, 0.25 - i / 4000], i % 3) for i in range(400, 600)]
    rows += [(50, [0.5, 0.25], 0), (50, [0.5, 0.3], 0), (50, [0.4], 1), (1000, [], 1), (1050, None, 1), (1100, [0.1, None], 1), (1150, [0.1, 0.2], None)]
    rows += [(None, [0.1, 0.2], 1), (1200, [float("nan"), 0.1], 0), (1250, [float("inf"), 0.1], 0), (1300, [-0.5, -0.25], 0), (1350, [0.5, 0.25, 0.1], 2)]
    assert negatives_of(spark, rows) == negatives_plain(rows)
    assert negatives_of(spark, []) == []
    assert negatives_of(spark, [(50, [1.0], 1)]) == [] and negatives_of(spark, [(51, [1.0], 1), (52, [1.0], 2)]) == []


def test_large_components_score_exactly(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.randrange(-(2**14), 2**14) * 64.0 + rnd.choice([0.0, 0.5]) for _ in range(5)], i % 3) for i in range(200)]
    assert negatives_of(spark, rows) == negatives_plain(rows)


def test_bounds_skip_lists_and_lose_nothing(spark, monkeypatch, tmp_path):
    """On clustered vectors a search reads a part of the lists only."""
    rows = clustered(9, 3000)
    groups = hard_negatives.collapsed(hard_negatives.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label", 256), 6)
    index = hard_negatives.build_index(groups)
    vectors = [(r.q, r.label, r.key) for r in groups.collect()]
    read = []
    real = index.read
    index.read = lambda c: read.append(c) or real(c)
    q = np.array([v[0] for v in vectors[:20]], float)
    label = np.array([v[1] for v in vectors[:20]])
    ends = np.full(20, np.inf)
    slot, score, _, _ = hard_negatives.best(index, q, np.arange(20), label, True, -ends, ends, 6)
    for i in range(20):
        all_scores = sorted((float(np.dot(q[i], v[0])) for v in vectors if v[1] == label[i]), reverse=True)
        assert score[slot == i].tolist() == all_scores[:6]
    asked = len(read)
    assert asked < len(index.numbers)


def test_op11_and_op13_equal_their_sql(spark, duck):
    for name in ("op11_prefix_trie", "op13_hard_negatives"):
        got, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name])
        at = [want.columns.index(c) for c in got.columns]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
