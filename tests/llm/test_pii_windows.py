"""Windows of long texts, and recall of respelled entities on texts that the field wasn't trained on."""

import collections
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from siltstone.llm import pii


def plain_windows(text, taken):
    """Every trigger against every span."""
    out = []
    for m in pii.TRIGGER.finditer(text):
        covered = sum(max(0, min(e, m.end()) - max(s, m.start())) for s, e, _ in taken)
        if any(s < m.end() and m.start() < e for s, e, _ in taken) and m.end() - m.start() - covered < pii.LEAST:
            continue
        lo = max([0, m.start() - pii.REACH, *(e for _, e, _ in taken if e <= m.start())])
        hi = min([len(text), m.end() + pii.REACH, *(s for s, _, _ in taken if s >= m.end())])
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_equal_a_scan_of_all_spans(seed):
    rnd = random.Random(seed)
    parts = ["a.b@c.org", "1.2.3.4", "4111 1111 1111 1111", "+1 (234) 567-8901", "1 (234) 567-8901", "x at y dot z ", "u[at]v.w", "5500/0000/0000/0004", "word", "\n", " ", ", ", "1234567890123", "10[.]0[.]0[.]7"]
    for _ in range(60):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " ", " " * 60]) for _ in range(rnd.randrange(30)))
        spans = pii.base_spans(text)
        taken = pii.Taken(spans)
        assert pii.windows(text, taken) == plain_windows(text, spans)
        for _ in range(20):
            a = rnd.randrange(len(text) + 1)
            b = a + 1 + rnd.randrange(30)
            assert taken.meets(a, b) == any(s < b and a < e for s, e, _ in spans)
            assert taken.covered(a, b) == sum(max(0, min(e, b) - max(s, a)) for s, e, _ in spans)


@pytest.mark.parametrize("line", ["user{i}@mail{i}.example.com, ", "10.{a}.{b}.7 and +1 (234) 567-{c}\n", "user{i} at mail dot example dot com; "])
def test_a_megabyte_of_entities_is_quick(line):
    text = ""
    field = pii.Field({"bias": pii.np.array([-9.0] * 4), "address": pii.np.array([20.0, 0, 0, 0])})
    rows = [line.format(i=i, a=i % 250, b=i % 199, c=1000 + i % 8999) for i in range(50_000)]
    text = "".join(rows)[: 1_100_000 if "@" in line or "+" in line else 30_000]
    start = time.perf_counter()
    base = pii.base_spans(text)
    taken = pii.Taken(base)
    found = [x for lo, hi in pii.windows(text, taken) for x in field.best(text[lo:hi])]
    assert time.perf_counter() - start < 5
    assert len(base) > 20_000 or len(found) > 700


def test_recall_on_texts_that_the_field_has_not_seen():
    """Half of the texts with digits or at-signs train the field as the query does; the others are respelled whole."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    some = [t for t in texts if t and re.search(r"[0-9]{3}|@", t)]
    random.Random(1).shuffle(some)
    half = len(some) // 2
    shown = [t[s:e] for t in some[:half] for s, e in pii.windows(t, pii.Taken([]))]
    random.Random(2).shuffle(shown)
    cases = []
    for turn, window in enumerate(shown[:500]):
        gold = pii.base_spans(window)
        cases += [(window, gold), pii.respell(window, gold, turn)] if gold else [(window, gold)]
    field = pii.Field.fit(cases)
    hit, wanted, wrong = collections.Counter(), collections.Counter(), 0
    for turn, text in enumerate(some[half:]):
        base = pii.base_spans(text)
        if not base:
            continue
        respelled, gold = pii.respell(text, base, turn)
        seen = pii.base_spans(respelled)
        taken = pii.Taken(seen)
        added = {(a + lo, b + lo, k) for lo, hi in pii.windows(respelled, taken) for a, b, k in field.best(respelled[lo:hi]) if not taken.meets(a + lo, b + lo)}
        for g in set(gold) - set(seen):
            wanted[g[2]] += 1
            hit[g[2]] += g in added
        wrong += len(added - set(gold))
    assert set(wanted) == {0, 1, 2, 3} and min(wanted.values()) > 30
    assert all(hit[k] >= 0.9 * wanted[k] for k in wanted), (hit, wanted)
    assert wrong <= 0.05 * sum(wanted.values())


def test_query_counts_base_spans_also_where_the_field_adds_some(spark, tmp_path):
    """Counts and hash of op9_pii are those of the base patterns; ids beside a null keep all their digits."""
    from siltstone.llm import queries

    texts = [f"call +1 ({200 + i}) 555-{1000 + i} now or mail me{i}@mail.example.com, card 4111111111111111, host 10.0.0.{i}" for i in range(60)]
    texts += [f"the number {1234567890123456 + 10 * i} and order {70000 + i} are no entities" for i in range(60)]
    texts += ["mail x at mail dot example dot com", "call (974) 555-3436 now", "card 4111/1111/1111/1111", "host 10[.]0[.]0[.]7", None]
    rows = [(2**60 + i, text) for i, text in enumerate(texts)] + [(None, "a@b.c")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_pii(spark, str(tmp_path)).collect()}
    assert sum(r.n_added for r in got.values()) > 0
    for doc_id, text in rows:
        r, base = got[doc_id], pii.base_spans(text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, _, k in base) for kind in range(4)]
        assert r.n_added + len(base) == r.all_email + r.all_ip + r.all_card + r.all_phone == len(r.spans.split(",") if r.spans else [])
