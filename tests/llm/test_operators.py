"""Each operator against a plain version, on the supplied tables and on awkward ones."""

import base64
import collections
import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bpe, exact_dedup, minhash, mixing, pii, spotsigs, token_count, token_store, toxicity, warc
from siltstone.llm.common import scratch, tokenizer_file

DATA = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end"
AWKWARD = [
    (1, None, None),
    (2, "", "b"),
    (3, " \t\n\x0b\x0c\r ", "b"),
    (4, "one two", "a"),
    (5, "one  two", "a"),
    (5, "one  two", "a"),
    (6, LONG, "a"),
    (7, LONG + "s", None),
    (8, "The idiot wrote to a.b@c.org from 1.2.3.4, call +1 (234) 567-8901 or 4111 1111 1111 1111.", "ä"),
    (9, "😀 漢字 é <|endoftext|> x ", "z"),
    (None, "no id", "z"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, source string")
    names = "id key part body digest salt n words size items comp pivot slot shard toxic term first url html group_size component_id".split()
    return df.select("*", *(F.lit("x").alias(c) for c in names))


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def ids(rows):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in rows)


ALL = sorted(-1 if r[0] is None else r[0] for r in AWKWARD)


# --- 1 exact dedup ---------------------------------------------------------------------------------------------


def dedup_plain(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for body, members in groups.items():
        keep = min(members)[2]
        out += [(m[2], keep, len(members), m[2] == keep, hashlib.sha256(body.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup(documents, awkward, empty, digest):
    for df in (documents, awkward):
        got = exact_dedup.exact_groups(df, digest=digest).select("doc_id", "keep_id", "group_size", "kept", F.sha2(exact_dedup.normalised(F.lit("")), 256)).collect()
        want = dedup_plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        assert sorted((tuple(r[:4]) for r in got), key=repr) == sorted((w[:4] for w in want), key=repr)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_digest(awkward):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_groups(awkward).collect()}
    assert got[3] == hashlib.sha256(b"").hexdigest() and got[4] == got[5] == hashlib.sha256(b"onetwo").hexdigest()


# --- 2 fingerprints --------------------------------------------------------------------------------------------


def test_spotsigs(documents, awkward, empty):
    for df in (documents, awkward.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
        got = {r.doc_id: r for r in spotsigs.edit_and_compare(df).collect()}
        prints = {}
        parts = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
        for i, (doc_id, text) in enumerate(rows):
            after, q = rows[(i + 1) % len(rows)], len(text) // 4
            edited = text[: len(text) - q] + after[1][:q]
            g = got[doc_id]
            assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert prints.setdefault(text, g.fingerprint) == g.fingerprint
            a = parts(g.fingerprint)
            for b, near in ((parts(g.edited_fingerprint), g.near_edited), (parts(got[after[0]].fingerprint), g.near_next)):
                assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert ids(spotsigs.edit_and_compare(awkward).collect()) == ALL
    assert spotsigs.edit_and_compare(empty).count() == 0


def test_spotsigs_null_and_repeated_ids(spark):
    """Rows with one id follow each other by text; null ids are a block of their own, whose last row is followed by nothing."""
    rows = [(1, "b b b b"), (1, "a a a a"), (2, None), (None, "d d d d"), (None, "c c c c")]
    got = sorted(spotsigs.edit_and_compare(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_chars, r.edited_sha256))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == collections.Counter(
        [(1, sha("a a a b")), (1, sha("b b b ")), (2, sha("")), (None, sha("c c c d")), (None, sha("d d d "))]
    )


def test_shared_passages_share_signatures(spark, documents):
    plain, spotted = " ".join(f"w{i}" for i in range(60)), " ".join(f"the v{i} x{i}" for i in range(40))
    rows = [(1, plain), (2, spotted), (3, "the " + plain), (4, "of the " * 300), (5, "one w1 w2 w3 w4 w5 w6 of"), (6, spotted)]
    got = {r.doc_id: r.near_edited for r in spotsigs.edit_and_compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] >= 0.4 for i in (1, 2, 3, 5)) and got[4] > 0
    long = documents.where(F.size(F.split(F.trim("text"), " +")) >= 8)
    assert spotsigs.edit_and_compare(long).where("near_edited = 0").count() == 0


def signatures_plain(text):
    """Signatures of a text as tuples of words, by a walk over its words from right to left."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    if len(words) == 1:
        return {(words[0],)}
    anchor = [w in spotsigs.ANCHORS for w in words]
    content = [i for i, a in enumerate(anchor) if not a]
    # an anchor begins a spot unless MAX_RUN anchors follow at once, or fewer than two content words follow in the text
    starts = [a and not all([*anchor[i + 1 : i + 5], False][:4]) and sum(c > i for c in content) >= 2 for i, a in enumerate(anchor)]
    blocks, at = [], 0
    while at < len(words):
        end = at
        while starts[end]:
            end += 1
        blocks.append((tuple(words[at:end]), words[end]))
        at = end + 1
    return {
        (*run, first, second) if run else (first, run_after[0] if run_after else second)
        for (run, first), (run_after, second) in zip(blocks, blocks[1:])
    }


def test_signatures_equal_a_plain_walk(spark, documents):
    texts = [r.text for r in documents.select("text").collect() if r.text and r.text.isascii() and len(r.text) < 3000]
    texts += ["", "one", "the", "the of", "a the one", "the one two", "of the in a to the x y z", "x of the y of", "of the in a to x", "the a b the", "one two three", "a 1_2 b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.sigs for r in spotsigs.with_signatures(rows, "text", "sigs").collect()}
    # signatures are hashes: equal sets must have equal sizes, and the hash of a signature must be one for all texts
    named = {}
    for i, t in enumerate(texts):
        want = signatures_plain(t)
        assert len(got[i]) == len(want), (t, want)
        for s in got[i]:
            named.setdefault(s, set()).add(i)
    held = {}
    for i, t in enumerate(texts):
        for s in signatures_plain(t):
            held.setdefault(s, set()).add(i)
    assert sorted(map(sorted, named.values())) == sorted(map(sorted, held.values()))


def test_spotsig_pairs_equal_all_pairs(documents):
    sets = {r.doc_id: frozenset(r.sigs) for r in spotsigs.with_signatures(documents.select("doc_id", "text"), "text", "sigs").collect() if r.sigs}
    reps = {}
    for k in sorted(sets):
        reps.setdefault(sets[k], k)
    items = sorted((k, s) for s, k in reps.items())
    want = {(a, b) for i, (a, x) in enumerate(items) for b, y in items[i + 1 :] if len(x & y) / len(x | y) >= 0.75}
    got = {(r.a, r.b) for r in spotsigs.near_pairs(documents).collect()}
    assert got == want and want


# --- 3 token counts --------------------------------------------------------------------------------------------


def test_token_counts(documents, awkward, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.unigram_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    for df in (documents, awkward):
        for r in token_count.count_tokens(df, vocabulary).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            assert r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids)
    assert ids(token_count.count_tokens(awkward, vocabulary).collect()) == ALL and token_count.count_tokens(empty, vocabulary).count() == 0


def test_token_count_ties_and_crossing_pieces():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.5), ("a▁b", -2.25), ("▁a", -1.5)]
    tok = Tokenizer(models.Unigram(vocabulary, unk_id=0))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    count = token_count.Counter(vocabulary)
    for text in ("abab", "aba ba ab", "a b a b", "bbaab aabab"):
        assert count(text) == len(tok.encode(text, add_special_tokens=False).ids)


# --- 4 mixing --------------------------------------------------------------------------------------------------


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [3, 1, 2], 45, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    assert mixing.water_fill([1, 100], [3, 1], 50, 2) == [2.0, 48.0]
    assert mixing.water_fill([1, 1], [1, 1], 50, 2) == [2.0, 2.0]
    assert mixing.water_fill([0, 5], [1, 1], 5, 2) == [0.0, 5.0] and mixing.water_fill([], [], 0, 2) == []


@pytest.mark.parametrize("budget", [0.2, 1.5, 1.9, 5.0])
def test_water_filled_equals_plain(spark, budget):
    rng = np.random.default_rng(3)
    names = [None, "", *(f"s{i:02d}é" for i in range(20)), "a", "Z", "😀"]
    sizes = [int(x) for x in rng.integers(0, 60, len(names))]
    sizes[3:6] = [0, 7, 7]
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, (names[i] or "").encode()))
    want = mixing.water_fill([sizes[i] for i in order], [(3, 1, 2)[k % 3] for k in range(len(order))], budget * sum(sizes), 2.0)
    rows = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_filled(rows, (3, 1, 2), budget, 2.0).collect()}
    assert [got[names[i]] for i in order] == pytest.approx(want)


def test_mix_awkward_targets(awkward):
    """Null and repeated ids, a null source and empty texts: sizes are counted by row, each source comes near its target."""
    rows = awkward.select("doc_id", "text", "source").collect()
    got = mixing.mix(awkward).collect()
    by = collections.defaultdict(int)
    for r in rows:
        by[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {r.source: r.source_size for r in got} == by
    for source, size in by.items():
        assert sum(r.taken for r in got if r.source == source) <= 2 * size
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == sorted(
        (-1 if r.doc_id is None else r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows
    )


def test_mix(documents, awkward, empty):
    got = mixing.mix(documents).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in documents.collect()}
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == size[r.doc_id] and r.taken <= 2 * r.size and r.taken == r.times * r.size
        by[r.source].append(r)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * sum(size.values()))
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.05 * rows[0].target
    again = mixing.mix(documents.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    odd = mixing.mix(awkward).collect()
    assert ids(odd) == ALL and {r.size for r in odd if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(empty).count() == 0


# --- 5 token store ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    assert sorted(token_store.permute(np.arange(n), n, 7)) == list(range(n))


def test_token_store_round_trip(spark, documents, awkward, empty):
    from tokenizers import Tokenizer

    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    for df in (documents, awkward, empty):
        out = scratch(spark, "test-tokens")
        manifest = token_store.materialise(df, out, ranks, key=3, length=32, per_shard=100)
        rows = token_store.read_sequences(manifest, out, length=32).collect()
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            x = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 50256], "<u2")
            want.update((r.doc_id, k // 32, len(x[k : k + 32]), hashlib.sha256(x[k : k + 32].tobytes()).hexdigest()) for k in range(0, len(x), 32))
        assert collections.Counter((r.doc_id, r.seq_no, r.n_tokens, r.ids_sha256) for r in rows) == want
        rest = token_store.read_sequences(manifest, out, length=32, from_slot=len(rows) // 2).collect()
        assert sorted(r.slot for r in rest) == list(range(len(rows) // 2, len(rows)))


def test_reads_have_a_task_for_each_stretch(spark, documents):
    out = scratch(spark, "test-tokens")
    manifest = token_store.materialise(documents, out, tokenizer_file("byte_bpe_50k.tiktoken"), length=32, per_shard=100)
    shards = manifest.count()
    assert shards > 10 and token_store.read_sequences(manifest, out, length=32, per_task=2).rdd.getNumPartitions() == -(-shards // 2)
    out = scratch(spark, "test-warc")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    index = warc.write_archives(pages, out, roll_bytes=20_000)
    files = index.select("file").distinct().count()
    assert files > 3 and warc.read_records(index, out).rdd.getNumPartitions() == files


# --- 6 MinHash -------------------------------------------------------------------------------------------------


def near_plain(rows):
    sets = collections.defaultdict(list)
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id].append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(100 * len(x & y) >= 75 * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i][0]), root(i), root(i) == i) for i in keys}


@pytest.mark.parametrize("options", [{}, {"small": 1, "block": 2}, {"salted": 2}])
def test_near_duplicates(spark, documents, awkward, empty, options):
    words = [f"w{i}" for i in range(60)]
    family = [(1000 + k, " ".join(w if (i * 7 + k) % 23 else f"x{k}" for i, w in enumerate(words))) for k in range(12)]
    family += [(2000 + k, " ".join(words + [f"tail{j}" for j in range(k)])) for k in range(0, 30, 2)]
    frames = [documents.select("doc_id", "text"), awkward.where("doc_id is not null"), spark.createDataFrame(family, "doc_id long, text string")]
    for df in frames if not options else frames[2:]:
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **options).collect()}
        assert got == near_plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    if not options:
        assert ids(minhash.near_duplicates(awkward).collect()) == ALL and minhash.near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 2000):
        items = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = minhash.sketch(np.unique(items[: n + n // 2])), minhash.sketch(np.unique(items[n // 2 :]))
        assert (a != np.iinfo(np.uint64).max).all()
        assert abs((a == b).mean() - len(set(items[: n + n // 2]) & set(items[n // 2 :])) / len(set(items))) < 0.2


def test_tile_counts_equal_plain_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(40)]
    got = minhash._common(sets[:15], sets[15:], cells=1 << 11)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]).all()


# --- 7 WARC ----------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    more = [(9001, None, None), (9002, "a\r\nb", ""), (9003, "x", "é" * 10), (9004, "y", "é" * 10), (9004, "y", "é" * 10)]
    df = pages.union(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 5000)).union(spark.createDataFrame(more, pages.schema)).withColumn("file", F.lit("x")).withColumn("digest", F.lit("y"))
    for least in (0, 1000):
        out = scratch(spark, "test-warc")
        index = warc.write_archives(df, out, revisit_from=least, roll_bytes=20_000)
        got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index, out, gap=10, request=30_000).collect())
        first = {}
        rows = sorted((r.page_id, (r.html or "").encode()) for r in df.collect())
        for page_id, html in rows:
            first.setdefault(html, page_id)
        want = []
        for page_id, html in rows:
            revisit = len(html) >= least and first[html] != page_id
            want.append((page_id, len(html), base64.b32encode(hashlib.sha1(html).digest()).decode(), "revisit" if revisit else "response", first[html] if revisit else None))
        assert got == sorted(want, key=lambda x: x[:4])
        assert index.select("file").distinct().count() > 1
    out = scratch(spark, "test-warc")
    assert warc.read_records(warc.write_archives(df.where("false"), out), out).count() == 0


def test_warc_null_page_ids_and_hot_payloads(spark):
    """A page without id never answers for others that have one; groups beyond a thousandth of all pages are answered like the rest."""
    rows = [(None, "u", "same"), (None, None, "same"), (7, "u", "same"), (9, "u", "same"), (None, "u", "alone"), (None, "v", "alone")]
    rows += [(100 + i, "h", "hot") for i in range(3000)] + [(5000 + i, "p", f"pair {i // 2}") for i in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = scratch(spark, "test-warc")
    got = warc.read_records(warc.write_archives(df, out), out).collect()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    want = collections.Counter({(None, "revisit", 7): 2, (7, "response", None): 1, (9, "revisit", 7): 1, (None, "response", None): 2})
    want.update((100 + i, "revisit" if i else "response", 100 if i else None) for i in range(3000))
    want.update((5000 + i, "revisit" if i % 2 else "response", 4999 + i if i % 2 else None) for i in range(4000))
    assert kinds == want


# --- 8 BPE -----------------------------------------------------------------------------------------------------


def test_bpe(spark, documents, awkward, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    odd = [(100 + i, t) for i, t in enumerate(["it's 'll don't''s", "a\u0085b", " <|endoftext|>x<|endoftext|><|endoftext|> ", "²³ Ⅷ ١٢٣", " " * 40 + "x", "\n\n \n", "<|endoftext"])]
    for df in (documents, awkward, spark.createDataFrame(odd, "doc_id long, text string")):
        text = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        got = bpe.encode_decode(df, path).collect()
        assert len(got) == df.count()
        for r in got:
            x = tok.encode(text[r.doc_id], add_special_tokens=False).ids
            back = tok.decode(x, skip_special_tokens=False)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert bpe.encode_decode(empty, path).count() == 0


# --- 9 PII -----------------------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def spans_plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "@a.b", "a@@b.c", "x@y z@w.q", "..a@b-.c.d.", "a" * 9000 + "@b.c@e.f", "1.2.3.4.5 999.1.1.1", "+1234567890+1 234 567 8901", "4111-1111 1111-1111", "0000.0255.1.1"])
def test_base_spans(text):
    assert pii.base_spans(text) == spans_plain(text)


def test_pii(documents, awkward, empty):
    for df in (documents, awkward):
        text = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        got = pii.find_pii(df).collect()
        assert len(got) == df.count()
        for r in got:
            base = pii.written_out(spans_plain(text[r.doc_id]))
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            all_ = r.spans.split(",") if r.spans else []
            assert set(base.split(",")) - {""} <= set(all_)
            assert [sum(s.startswith(k + ":") for s in all_) for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
    assert pii.find_pii(empty).count() == 0


def test_field_finds_what_touching_patterns_hide():
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} now or mail me{i}@mail.example.com, card 4111111111111111, host 10.0.0.{i}" for i in range(40)]
    texts += [f"the number {1234567890123456 + 10 * i} and order {70000 + i} are no entities" for i in range(40)]
    cases = [(t, pii.base_spans(t)) for t in texts]
    field = pii.Field.fit(cases + [pii.respell(t, g, i) for i, (t, g) in enumerate(cases)])
    text = "call +1 (974) 555-3436 4111111111111111 now"
    assert pii.base_spans(text) == []
    found = {(pii.KINDS[k], text[a:b]) for a, b, k in field.best(text)}
    assert found == {("phone", "+1 (974) 555-3436"), ("card", "4111111111111111")}
    assert field.best("the number 1234567890123456 is no card, nor is 12345") == []


def test_field_equals_the_best_of_all_segmentations():
    rng = np.random.default_rng(5)
    text = "tel (974) 555-3436 10[.]0[.]0[.]7 x"
    n, segs = pii.candidates(text)
    names = {f for _, _, a, b in segs for f in pii.features(text, a, b)}
    for _ in range(5):
        field = pii.Field({f: rng.normal(0, 1, 4) for f in sorted(names)})
        score = {(a, b): field.scores([pii.features(text, a, b)])[0] - 0.5 for _, _, a, b in segs}

        def best(at):
            """The best value from an atom on, over every choice of segments, by plain recursion."""
            if at == n:
                return 0.0
            return max([best(at + 1), *(score[a, b].max() + best(j) for i, j, a, b in segs if i == at)])

        found = field.best(text, margin=0.5)
        assert sum(score[a, b][k] for a, b, k in found) == pytest.approx(best(0))
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_added_spans_recall_and_precision():
    """Respelled entities that the patterns miss are found; look-alikes are left alone."""
    make = lambda i: f"call +1 ({200 + i}) 555-{1000 + i} or mail me{i}@mail.example.com, card 4111111111111111, host 10.0.{i}.7 now"
    plain = lambda i: f"order {1234567890123456 + 10 * i} of {70000 + i} parts at {i}.5 or 2024-0{1 + i % 9}-1{i % 10} is no entity"
    learn = [(make(i), pii.base_spans(make(i))) for i in range(40)]
    field = pii.Field.fit(learn + [pii.respell(t, g, i) for i, (t, g) in enumerate(learn)] + [(plain(i), []) for i in range(40)])
    hit = wanted = found = 0
    for i in range(100, 160):
        text, gold = pii.respell(make(i), pii.base_spans(make(i)), i)
        missed = set(gold) - set(pii.base_spans(text))
        got = set(field.best(text))
        hit, wanted, found = hit + len(got & missed), wanted + len(missed), found + len(got - set(gold))
        assert field.best(plain(i)) == []
    assert wanted > 100 and hit >= 0.8 * wanted and found <= 0.05 * wanted


# --- 10 toxicity -----------------------------------------------------------------------------------------------


def test_automaton_equals_edit_distance():
    words = ["idiot", "moron", "worthless"]
    trie = toxicity.Trie(words)
    letters = "idotmrnwx"

    def edits(w):
        yield w
        for i in range(len(w) + 1):
            for c in letters:
                yield w[:i] + c + w[i:]
                if i < len(w):
                    yield w[:i] + c + w[i + 1 :]
            if i < len(w):
                yield w[:i] + w[i + 1 :]

    for w in words:
        near = set(edits(w))
        assert all(trie.near(x) == w for x in near)
        assert trie.near(w[::-1]) is None and trie.near(w + "xx") is None and trie.near("") is None


def test_misspelled_stems_swaps_and_long_terms():
    lex = toxicity.Lexicon({"bomenter": 5.0, "worthless$": 5.0, "stupid$": 5.0})
    for text in ("bomnterado", "bomxenteros", "bomenetra", "bmoenters", "worhtless", "wrthlss", "wxorthlesss", "stupdi"):
        assert 0 < lex.evidence(text, {})[0] < 5, text
    assert lex.evidence("bomenteros", {})[0] == 5
    for text in ("bmoetners", "worthy", "stpdu", "wrtlss", "a" * 50_000):
        assert lex.evidence(text, {})[0] == 0, text
    assert toxicity.Lexicon({"bomenter": 5.0}, frozenset({"bomnter*"})).evidence("bomnterado", {})[0] == 0
    assert lex.lookup("bomnterado") == (5.0 * toxicity.FUZZY, "bomnter*")


def test_context_lowers_quoted_terms():
    lex = toxicity.Lexicon({"idiot$": 5.0})
    score = lambda t: lex.evidence(t, {})[0]
    assert score("you idiot") > score("an idiot") > score('he wrote the word "idiot" twice') > 0
    assert score("an idoit here") == 0 and 0 < score("an idot here") < 5


def plain_distance(a, b):
    """Edits between two words; neighbours that change places count one edit."""
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_evidence_equals_a_plain_scorer():
    """Scores by comparing every word with every term by plain edit distance, without the trie."""
    weights = {"worthless$": 5.0, "imbecile$": 4.0, "stupid$": 3.0, "bomenter": 6.0, "pig$": 2.0}
    lex = toxicity.Lexicon(weights, frozenset({"imbeciles"}))

    def worth(word):
        if word + "$" in weights:
            return weights[word + "$"]
        if word.startswith("bomenter"):
            return 6.0
        if word in lex.benign:
            return 0.0
        found = []
        for t, w in weights.items():
            bare, most = t.rstrip("$"), toxicity.edits_allowed(t.rstrip("$"))
            ends = [len(word)] if t.endswith("$") else range(1, len(word) + 1)
            e = min((plain_distance(word[:k], bare) for k in ends), default=9)
            if e <= most:
                found.append((e, not t.endswith("$"), w))
        return min(found)[2] * toxicity.FUZZY ** min(found)[0] if found else 0.0

    words = "worthless wrthless worthlses worthles imbecile imbeciles imbecil imbeciel stupid stupdi stpuid stopid bomenterado bomentrada bmoenteros bomxenter pig pigs pg plain words only".split()
    for w in words:
        assert lex.evidence(f"so {w} here", {})[0] == pytest.approx(worth(w)), w
    text = " and ".join(words)
    assert lex.evidence(text, {})[0] == pytest.approx(sum(map(worth, words)))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted for r in got if r.toxic)
    false = sum(r.predicted for r in got if not r.toxic)
    assert hits >= 0.8 * sum(r.toxic for r in got) and false <= 0.02 * len(got)


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 0, 0), (4, 0, 0), (77, 1, 1), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(awkward, labels).collect()
    assert ids(got) == ALL and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(awkward, labels.where("false")).count() == len(ALL)


def test_learning_ignores_held_out_labels(spark):
    import zlib

    rows = [(i, "plain text here" + (" grumbolt" if zlib.crc32(str(i).encode()) % 3 == 1 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.contains("text", F.lit("grumbolt")).cast("int").alias("toxic"))
    assert not any(t.startswith("grum") for t in [*toxicity.fit(docs, labels).whole, *toxicity.fit(docs, labels).stems])


# --- the pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    docs = documents
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark, "test-stage")
        stage(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        before_ids, after_ids = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, after))
        assert after_ids <= before_ids
        if name == "toxicity":
            assert all(labels.get(i) for i in before_ids - after_ids if i in labels)
        if name in ("exact_dedup", "near_dedup"):
            check = exact_dedup.exact_groups(after) if name == "exact_dedup" else minhash.near_duplicates(after)
            assert check.where("not kept").count() == 0
        docs = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(rows) == docs.count()


def test_pipeline_on_awkward_tables(spark, awkward, empty):
    import corpus_pipeline

    rich = lambda df: df.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(0).cast("long").alias("n_chars"))
    for df in (rich(awkward), rich(empty)):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            path = scratch(spark, "test-stage")
            stage(spark, docs, DATA).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.columns[:2] == ["doc_id", "n_tokens"]


def test_pipeline_run_equals_its_stages_and_leaves_one_table(spark):
    import corpus_pipeline as pipeline
    from siltstone.llm.common import MADE

    before = set(MADE)
    got = sorted(map(tuple, pipeline.run(spark, DATA).collect()), key=repr)
    left = {p.split("siltstone-")[-1].rsplit("-", 1)[0] for p in set(MADE) - before}
    assert left == {"stage-mix_sources", "words"}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        path = scratch(spark, "test-stage")
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
    assert sorted(map(tuple, pipeline.STAGES[-1][1](spark, docs, DATA).collect()), key=repr) == got


def test_pipeline_stages_decide_on_rows(spark):
    import corpus_pipeline as pipeline

    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "alpha  beta", "a"), (1, "gamma", "a"), (2, "alpha beta", "a"), (3, "gamma  ", "a"), (4, "same", "a"), (4, "same", "a"), (None, "x y", "a"), (None, "x y", "a"), (None, None, "a")]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string")
    got = lambda df: sorted(map(tuple, df.collect()), key=repr)
    left = sorted([rows[0], rows[3], rows[4], rows[6], rows[8]], key=repr)
    assert got(pipeline.exact(spark, frame(rows), DATA)) == left
    twins = [(7, near, "a"), (7, near + " end", "a"), (5, "other words", "a"), (None, near + " tail", "a"), (5, near + " more", "a"), (None, None, "a")]
    assert got(pipeline.minhash(spark, frame(twins), DATA)) == sorted([twins[2], twins[4], twins[5]], key=repr)
    many = [(None if i % 3 else i // 6, f"w{i} " * 4, "a") for i in range(60)]
    mixed = collections.Counter(got(pipeline.mixed(spark, frame(many), DATA)))
    assert set(mixed) == set(many)
    times = collections.Counter()
    for r in mixing.mix(frame(many)).collect():
        times[r.doc_id] += r.times
    kept = collections.Counter()
    for row, n in mixed.items():
        kept[row[0]] += n
    assert kept == times


def test_pipeline_drops_toxic_rows_without_ids(spark, documents):
    import corpus_pipeline as pipeline

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    bad = toxicity.score_toxicity(documents, labels).where("predicted = 1").join(documents, "doc_id").first()
    extra = spark.createDataFrame([(None, bad.text), (None, "plain words"), (bad.doc_id, "plain words"), (None, None)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(extra).repartition(2)
    after = pipeline.toxicity(spark, docs, DATA).where(F.col("doc_id").isNull() | (F.col("doc_id") == bad.doc_id)).collect()
    assert sorted(map(tuple, after), key=repr) == sorted([(None, "plain words"), (bad.doc_id, "plain words"), (None, None)], key=repr)


def test_queries_are_registered():
    from siltstone.llm.queries import ORACLE_SQL, QUERIES

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and json.dumps(ORACLE_SQL)


def test_op1_equals_its_sql(spark, duck):
    from siltstone.llm.queries import ORACLE_SQL, QUERIES

    got = sorted(tuple(r) for r in QUERIES["op1_exact_dedup"](spark, DATA).collect())
    assert got == sorted(duck.execute(ORACLE_SQL["op1_exact_dedup"]).fetchall())
