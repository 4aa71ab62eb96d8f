"""Queries that SQL can't express, against plain versions of what they compute."""

import collections
import difflib
import hashlib
import html
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import chunking as C
from siltstone.operators import entities as E
from siltstone.plans import all_queries, all_sql
from siltstone.sources import converters as X

DATA = "/root/testdata/sf0.001"
#: Queries without SQL and the test that holds each against a plain version.
COVERED = {
    "J07_explained_search", "D11_known_mentions", "D12_pattern_mentions", "D02_legacy_chunks", "D05_code_chunks", "D08_chunks",
    "D10_chunk_rows", "A05_html_text", "A06_html_table_rows", "D15_hash_embedding", "N03_evidence_cards", "B05_evidence_documents",
}


def rows_of(name, spark):
    return all_queries()[name](spark, DATA).collect()


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_every_query_is_checked():
    assert set(all_queries()) - set(all_sql()) == COVERED


def test_explained_search_follows_the_priorities(spark):
    by = collections.defaultdict(list)
    for r in rows_of("J06_context_priority", spark):
        by[r.query_id].append(r)
    got = rows_of("J07_explained_search", spark)
    assert got and {r.query_id for r in got} == set(by)
    for q, rows in by.items():
        shown = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        best = sorted((-r.priority, r.chunk_id) for r in rows)[:8]
        assert [-r.priority for r in shown] == pytest.approx([p for p, _ in best], abs=2e-5) and len(shown) == min(8, len(rows))
        known = {r.chunk_id: r for r in rows}
        for r in shown:
            said = dict(x.split(":", 1) for x in r.reasons.split("; "))
            assert float(said["trust"]) == pytest.approx(known[r.chunk_id].trust, abs=6e-4)
            assert float(said["status"]) == pytest.approx(known[r.chunk_id].status_score, abs=6e-4)
            assert (said["conflicts"] == "none") == (known[r.chunk_id].penalty == 0)


def test_known_mentions_equal_a_scan_of_all_pairs(spark):
    names = [(f"bench:{r.item_id}", m[0]) for r in read(spark, "benchmark").collect() if (m := re.search(r"\w+\W+\w+", r.text, re.A))]
    want = set()
    for d in read(spark, "documents").collect():
        for node, alias in names:
            for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(alias)}(?![A-Za-z0-9_])", d.text or "", re.I):
                want.add((d.doc_id, node, alias, m.start(), m.end()))
    got = {(r.chunk_id, r.node_id, r.alias, r.start, r.end) for r in rows_of("D11_known_mentions", spark)}
    assert got == want and want


def test_pattern_mentions_equal_a_plain_pattern(spark):
    plain = re.compile(E.CAPITALISED, re.A)
    texts = {d.doc_id: d.text for d in read(spark, "documents").collect() if d.text and d.text.isascii()}
    want = collections.Counter((i, s) for i, t in texts.items() for m in plain.finditer(t) if len(s := m[0].strip()) >= 4)
    got = collections.Counter((r.chunk_id, r.surface) for r in rows_of("D12_pattern_mentions", spark) if r.chunk_id in texts)
    assert got == want and want


def test_fuzzy_resolution_equals_all_pairs(spark):
    from siltstone.plans.evidence_queries import _mentions
    from siltstone.plans.registry import Tables
    from siltstone.plans.standins import view

    t = Tables(spark, DATA)
    entities = [(r.node_id, r.normalized) for r in E.graph_entities(view(t, "nodes"), view(t, "aliases")).select("node_id", "normalized").distinct().collect() if r.normalized.startswith("customer")]
    mentions = _mentions(t).withColumn("normalized", F.regexp_replace("normalized", "^customer", "custumer")).where("hint is null and mention_id % 50 = 1").collect()
    got = {r.mention_id: (r.status, r.node_id) for r in rows_of("L11_fuzzy_resolution", spark)}
    for m in mentions:
        scored = {}
        for node, text in entities:
            ratio = difflib.SequenceMatcher(None, m.normalized, text).ratio()
            if ratio >= 0.9:
                scored[node] = max(ratio, scored.get(node, 0))
        best = min(((-s, n) for n, s in scored.items()), default=None)
        # a fuzzy score is never sure, so the best candidate goes to review
        assert got[m.mention_id] == (("needs_review", best[1]) if best else ("unresolved", None))
    assert mentions


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab#.|- ", min_size=1, max_size=60), max_size=12), st.sampled_from(["plain", "markdown"]), st.integers(5, 90))
def test_chunks_are_as_long_as_they_can_be(parts, how, target):
    """Nothing is lost, blocks together never pass the target, and no chunk could have taken in the next block."""
    text = "\n\n".join(parts)
    clean = C._structured_text(text)
    find = C.plain_blocks if how == "plain" else C.note_blocks
    pieces = [p for b in find(clean) if b[2].strip() for p in C.cut_long(b, target)]
    got = C.chunk(text, how, target)
    at = 0
    for _, body, kinds in got:
        n, size = 0, 0
        while at + n < len(pieces) and (n == 0 or size + 2 + len(pieces[at + n][2]) <= target):
            size += len(pieces[at + n][2]) + (2 if n else 0)
            n += 1
        assert body == C._structured_text("\n\n".join(p[2] for p in pieces[at : at + n])) and kinds == sorted({p[0] for p in pieces[at : at + n]})
        at += n
    assert at == len(pieces)
    assert "".join(clean.split()) == "".join("".join(b.split()) for _, b, _ in got)


def test_overlapping_chunks():
    text = "# One\n\n" + "a" * 40 + "\n\n" + "b" * 40 + "\n\n# Two\n\n" + "c" * 10
    got = C.chunk(text, "legacy", 60, 10)
    assert [b for _, b, _ in got] == ["# One\n\n" + "a" * 40, "a" * 10 + "\n\n" + "b" * 40 + "\n\n# Two", "bbb\n\n# Two\n\n" + "c" * 10]
    assert [s for s, _, _ in got] == ["One", "Two", "Two"]
    assert C.chunk("x" * 30, "legacy", 10, 5)[-1][1] == "x" * 5 and C.chunk("", "legacy", 10, 5) == []


def test_code_is_cut_at_definitions_and_blank_lines():
    text = "import a\n\ndef one():\n    return 1\n\nclass Two:\n" + "    x = 1\n" * 120 + "\n    y = 2\n"
    blocks = list(C.code_blocks(text, "m.py"))
    assert [(s, b.split("\n")[0]) for _, s, b in blocks] == [("m.py", "import a"), ("one", "def one():"), ("Two", "class Two:"), ("Two", "    y = 2")]
    assert "".join("".join(b.split()) for _, _, b in blocks) == "".join(text.split())


def test_chunk_rows_of_queries(spark):
    """Digests, ids, tails and token estimates of every chunk, from the chunker applied to each text alone."""
    lang = {r.doc_id: r for r in read(spark, "documents").collect()}
    how = lambda r: "markdown" if r.lang == "en" or re.search(r"(?m)^#{1,6}\s+\S", r.text) or "```" in r.text else "plain"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, rows = set(), set()
    for i, r in lang.items():
        before = None
        for n, (section, body, kinds) in enumerate(C.chunk(r.text or "", how(r)), 1):
            want.add((i, n, how(r), section, ",".join(kinds), sha(body)))
            rows.add((i, f"chunk:{i}:{n:04d}:{sha(body)[:12]}", None if before is None else len(before[-250:].strip())))
            before = body
    assert {(r.doc_id, r.chunk_index, r.strategy, r.section, r.block_types, r.text_hash) for r in rows_of("D08_chunks", spark)} == want
    assert {(r.doc_id, r.chunk_id, r.tail) for r in rows_of("D10_chunk_rows", spark)} == rows
    legacy = {(i, n, sha(b)) for i, r in lang.items() for n, (_, b, _) in enumerate(C.chunk(r.text or "", "legacy"), 1)}
    assert {(r.doc_id, r.chunk_index, r.text_hash) for r in rows_of("D02_legacy_chunks", spark)} == legacy
    code = {(p.page_id, n, sha(b)) for p in read(spark, "pages").collect() for n, (_, b, _) in enumerate(C.chunk(p.html, "code"), 1)}
    assert {(r.doc_id, r.chunk_index, r.text_hash) for r in rows_of("D05_code_chunks", spark)} == code


def test_page_text_holds_the_visible_words(spark):
    pages = read(spark, "pages")
    files = pages.select(F.col("page_id").cast("string").alias("path"), F.encode("html", "utf-8").alias("content"), F.lit("text/html").alias("media_type"))
    got = {int(r.source_ref): r.text for r in X.convert(files).where("unit_type = 'page'").collect()}
    digests = {r.page_id: r for r in rows_of("A05_html_text", spark)}
    for p in pages.collect():
        bare = re.sub(r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ", p.html)
        words = html.unescape(re.sub(r"<[^>]*>", " ", bare)).split()
        if p.page_id in got:
            assert "".join(got[p.page_id].split()) == "".join(words)
            assert (digests[p.page_id].text_hash, digests[p.page_id].n_chars) == (hashlib.sha256(got[p.page_id].encode()).hexdigest(), len(got[p.page_id]))
        else:
            assert not words
    assert len(digests) == len(got) > 0


def test_table_rows_are_labelled(spark):
    want = {(p.page_id, f"Pages; id: {p.page_id}; address: {p.url}") for p in read(spark, "pages").collect()}
    assert want <= {(r.page_id, r.text) for r in rows_of("A06_html_table_rows", spark)}


def test_hash_embedding_equals_a_plain_one(spark):
    def plain(text, dims=384):
        low, out = text.lower(), np.zeros(dims)
        words = re.findall(r"[a-z0-9][a-z0-9_+\-./]{1,}", low)
        feats = words + [f"{a}_{b}" for a, b in zip(words, words[1:])] + [f"char:{low[i : i + 4]}" for i in range(0, min(len(text), len(low)) - 3, 2)]
        for f in feats:
            d = hashlib.blake2b(f.encode(), digest_size=8).digest()
            out[int.from_bytes(d[:4], "big") % dims] += 1 if d[4] & 1 else -1
        n = np.sqrt((out**2).sum())
        return out / n if n else out

    got = {r.doc_id: r.vector_hash for r in rows_of("D15_hash_embedding", spark)}
    for d in read(spark, "documents").collect():
        assert got[d.doc_id] == hashlib.sha256(plain(d.text or "").astype(np.float32).tobytes()).hexdigest()


def test_cards_hold_the_metrics_of_the_run(spark):
    cards = rows_of("N03_evidence_cards", spark)
    assert len({r.evidence_id for r in cards}) == len(cards) > 0 and not any(r.client_id == "c7" for r in cards)
    for r in cards:
        assert re.fullmatch(rf"ev:full_gtm_signal_check:{r.client_id}:[0-9a-f]{{16}}", r.evidence_id) and 0 < r.n_metrics <= 9
    run = collections.defaultdict(dict)
    for r in rows_of("N08_multi_client_run", spark):
        run[r.client_id][r.metric] = r.value
    texts = rows_of("B05_evidence_documents", spark)
    assert {r.evidence_id.split(":")[2] for r in texts} == set(run)
    for r in texts:
        client = r.evidence_id.split(":")[2]
        assert r.markdown.startswith(f"# Evidence: pipeline_health / {client}\n")
        lines = dict(re.findall(r"- (\w+): (-?[0-9.E]+) \(source: tables\)", r.markdown))
        assert {k: float(v) for k, v in lines.items()} == pytest.approx(run[client])
