"""Components, matching blocks, merges, the bucket store and the stored index, against plain versions."""

import difflib
import random
import sys

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import ledger, matching, retrieval, text_index
from siltstone.operators.components import components, looked_up
from siltstone.sources.store import Conflict, Store

DATA = "/root/testdata/sf0.001"


# --- components ------------------------------------------------------------------------------------------------


def plain_components(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "awkward", "none"])
def test_components_equal_a_plain_search(spark, kind):
    rnd = random.Random(kind)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(120)] + [(900, 901)],
        "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)],
        "awkward": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (7, 7), (7, 8)],
        "none": [],
    }[kind]
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.id: r.component for r in components(df).collect()} == plain_components(links)


def test_components_of_names(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {r.id: r.component for r in components(df).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


@pytest.mark.parametrize("hottest", [1, 2, 1000])
def test_lookup_keeps_all_rows(spark, hottest):
    """Hot and cold keys, keys without a value, and null keys."""
    rows = [(i, k) for i, k in enumerate([1] * 50 + [2] * 30 + [3, 4, None, None, 9])]
    table = spark.createDataFrame([(1, "a"), (3, "c"), (9, "i"), (10, "j")], "k long, v string")
    got = {(r.i, r.k, r.v) for r in looked_up(spark.createDataFrame(rows, "i long, k long"), table, "k", "v", hottest).collect()}
    assert got == {(i, k, {1: "a", 3: "c", 9: "i"}.get(k)) for i, k in rows}


# --- matching blocks -------------------------------------------------------------------------------------------


def close_pairs(texts, threshold):
    return {(a, b) for a in texts for b in texts if a and b and difflib.SequenceMatcher(None, a, b).ratio() >= threshold}


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.92])
def test_matching_texts_equal_all_pairs(spark, threshold):
    rnd = random.Random(4)
    texts = {"", "a", "ab", "acme", "acne", "aaaaaaaaaaaa", "aaaaaaaaaaab", "customer 000000012", "customer 000000021", "custumer 00000012"}
    for _ in range(25):
        base = "".join(rnd.choice("abcde ") for _ in range(rnd.choice([4, 9, 18, 30, 60])))
        texts.add(base)
        for _ in range(5):
            t = list(base)
            for _ in range(rnd.randrange(1, 6)):
                at = rnd.randrange(len(t) + 1)
                if rnd.random() < 0.5 and at < len(t):
                    del t[at]
                else:
                    t.insert(at, rnd.choice("abcdefg "))
            texts.add("".join(t))
    texts.add("ab" * 150)
    texts.add("ab" * 149 + "ba")  # long texts, whose common letters the matcher leaves out
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "text string")
    got = {(r.left, r.right) for r in matching.matching_texts(df, df, threshold).collect()}
    assert got == close_pairs(texts, threshold)


def test_matching_texts_stay_in_their_class(spark):
    df = spark.createDataFrame([("x", "alpha beta"), ("x", "alpha bete"), ("y", "alpha beta"), ("y", None)], "k string, text string")
    got = {(r.k, r.left, r.right) for r in matching.matching_texts(df, df, 0.9, ["k"]).where("left < right").collect()}
    assert got == {("x", "alpha beta", "alpha bete")}
    with pytest.raises(ValueError):
        matching.matching_texts(df, df, 0.5)


def test_close_names_of_all_nodes_equal_all_pairs(spark):
    """Links by name over the stand-in nodes, against a plain matcher on all pairs of a type."""
    from siltstone.functions import text as T
    from siltstone.plans.registry import Tables
    from siltstone.plans.standins import view

    nodes = view(Tables(spark, DATA), "nodes").where("status IN ('active', 'provisional')").withColumn("key", T.normalize_name(F.col("name")))
    rows = [(r.id, r.type, r.key) for r in nodes.collect() if r.key]
    none = spark.createDataFrame([], "node_id string, alias string")
    links = [(r.keep_id, r.id) for r in ledger.duplicate_entities(nodes, none).collect()]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    known = {}
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and known.setdefault((a[2], b[2]), a[2] == b[2] or ratio(a[2], b[2]) >= 0.9)]
    assert plain_components(links) == plain_components(want)


def numbered(rnd, n, base="customer", digits=9, most=3000):
    return sorted({f"{base} {rnd.randrange(most):0{digits}}" for _ in range(n)})


@pytest.mark.parametrize("left_n, right_n", [(5, 5), (6, 7), (12, 11), (18, 18)])
def test_blocks_of_many_pairs_equal_the_matcher(left_n, right_n):
    rnd = random.Random(left_n)
    pairs = []
    for _ in range(300):
        x = [rnd.choice(b"01" if rnd.random() < 0.8 else b"abc") for _ in range(left_n)]
        y = list(x)
        for _ in range(rnd.randrange(3)):
            del y[rnd.randrange(len(y))]
            y.insert(rnd.randrange(len(y) + 1), rnd.choice(b"01a"))
        y = (y + [rnd.choice(b"01") for _ in range(right_n)])[:right_n]
        pairs.append((x, y))
    left, right = (np.array(side, np.uint8) for side in zip(*pairs))
    matched = np.array([sum(b.size for b in difflib.SequenceMatcher(None, bytes(a), bytes(b)).get_matching_blocks()) for a, b in pairs])
    for least in range(min(left_n, right_n) + 1):
        assert (matching.blocks_reach(left, right, least) == (matched >= least)).all()


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.92, 0.996])
def test_close_texts_are_counted_where_they_meet(spark, monkeypatch, threshold):
    """Counts and classes equal those of all pairs, also where groups are cut by batches and texts are long or have several ids."""
    rnd = random.Random(7)
    texts = [*numbered(rnd, 60), "abab abab abab", "baba baba baba", "äbc дом 一二三 xyz", "äbc дом 一三二 xyz", "customer 0000000120", "acme", "acmes", "x" * 250, "x" * 249 + "y", "x" * 249, "ab" * 130, "ab" * 129 + "ba"]
    texts += ["".join(rnd.choice("ab") for _ in range(rnd.choice([9, 10, 11]))) for _ in range(60)]
    texts = sorted(set(texts))
    rnd.shuffle(texts)
    rows = [(k, t, f"n:{i}", f"n:{i}" if i % 3 else f"n:{i}:{rnd.choice('az')}" if i % 2 else "z") for k in "pq" for i, t in enumerate(texts[::2] if k == "p" else texts[1::2] + texts[:20])]
    rows = [(k, t, k + first, k + last) for k, t, first, last in rows]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() >= threshold
    want = {tuple(sorted((a[2], b[2]))) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and ratio(a[1], b[1])}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(matching, "PAIRS", 16)
    monkeypatch.setattr(matching, "CELLS", 1024)
    try:
        extra = [(None, texts[0], "x", "x"), ("p", "", "y", "y"), ("p", None, "z", "z"), ("p", texts[0] + "!", None, None)]
        n, links = matching.close_counts(spark.createDataFrame(rows + extra, "k string, text string, first string, last string"), threshold, ["k"])
        ends = [x for pair in want for x in pair]
        assert {r.id: r.n for r in n.collect()} == {x: ends.count(x) for x in ends}
        assert plain_components([tuple(r) for r in links.collect()]) == plain_components(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("repeated", [False, True])
def test_entity_classes_equal_the_classes_of_all_links(spark, repeated):
    rnd = random.Random(5)
    names = numbered(rnd, 80) + ["hot bolt", "hot bolts", "old widgets", "old widget"] * 3 + ["a long name of supplier number 0012", "a long name of supplier number 0021", "", None]
    nodes = [(f"n:{i}", "account" if i % 9 else "concept|x", name, "active" if i % 7 else "merged") for i, name in enumerate(names)]
    nodes += [("n:3", "account", names[5], "active"), ("n:3", "account", "hot bolts", "active"), ("null", None, names[0], "active")] if repeated else []
    aliases = [(f"n:{i}", names[(i * 3) % 90]) for i in range(0, 90, 4)] + [("n:1", "The Brand"), ("n:2", "Brand Inc"), (None, "x"), ("n:4", None)]
    nodes = spark.createDataFrame(nodes, "id string, type string, name string, status string")
    aliases = spark.createDataFrame(aliases, "node_id string, alias string")
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "component_id", "n_links").collect())
    got = rows(ledger.entity_classes(nodes, aliases))
    assert got and got == rows(ledger.linked_classes(ledger.duplicate_entities(nodes, aliases)))


def test_close_pairs_of_entities_are_not_listed(spark, monkeypatch):
    """The query's steps hold rows for names and their forms, not for close pairs, of which numbered names have dozens to hundreds each."""
    data = DATA.replace("sf0.001", "sf0.01")
    from siltstone.plans import all_queries
    from siltstone.plans.registry import Tables
    from siltstone.plans.standins import view

    nodes = view(Tables(spark, data), "nodes").where("type = 'account' AND status IN ('active', 'provisional')").count()
    sizes = []
    for module in (matching, ledger, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "written", lambda df, label, real=module.written: (lambda out: sizes.append((out.count(), label)) or out)(real(df, label)))
    out = all_queries()["E14_duplicate_entities"](spark, data).collect()
    assert sum(r.n_links for r in out) / 2 > 20 * nodes
    assert max(sizes)[0] < 10 * nodes


# --- merge and split -------------------------------------------------------------------------------------------


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def state(spark):
    nodes = [(c, f"Name {c}", "active") for c in "abcdefg"] + [("h", "Name a", "merged")]
    return {
        "nodes": spark.createDataFrame(nodes, "id string, name string, status string"),
        "aliases": spark.createDataFrame([("a", "first"), ("b", "second"), ("c", "third"), ("c", "first"), ("e", "")], "node_id string, alias string"),
        "tags": spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "dedupe-canonical")], "node_id string, tag string"),
    }


def test_a_chain_ends_in_one_node(spark, state):
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "e"), ("f", "zz"), ("zz", "g"), ("h", "a")], "keep_id string, id string")
    conflicts = spark.createDataFrame(
        [("1", "duplicate_entity", "b", "c", "open"), ("2", "duplicate_entity", "a", "b", "resolved"), ("3", "contradiction", "a", "b", "open"), ("4", "duplicate_entity", "a", "d", "acknowledged"), ("5", "duplicate_entity", "f", "g", "acknowledged")],
        "conflict_id string, conflict_type string, keep_id string, id string, status string",
    )
    after = ledger.merge_duplicates(state, links, conflicts)
    status = {r.id: r.status for r in after["nodes"].collect()}
    assert status == {"a": "active", "b": "merged", "c": "merged", "d": "active", "e": "merged", "f": "active", "g": "merged", "h": "merged"}
    aliases = {}
    for r in after["aliases"].collect():
        aliases.setdefault(r.node_id, []).append(r.alias)
    assert sorted(aliases["a"]) == ["Name a", "Name b", "Name c", "b", "c", "first", "h", "second", "third"]
    assert sorted(aliases["d"]) == ["Name e", "e"] and sorted(aliases["f"]) == ["Name g", "g"] and sorted(aliases["c"]) == ["first", "third"]
    assert {(r.node_id, r.tag) for r in after["tags"].collect()} == {("a", "x"), ("a", "dedupe-canonical"), ("b", "y"), ("d", "dedupe-canonical"), ("f", "dedupe-canonical")}
    done = {r.conflict_id: (r.status, r.resolution, r.canonical_id) for r in after["conflicts"].collect()}
    assert done["1"] == ("resolved", "merge_entities", "a") and done["5"] == ("resolved", "merge_entities", "f")
    assert done["2"] == ("resolved", None, None) and done["3"] == ("open", None, None) and done["4"] == ("acknowledged", None, None)
    assert after["changes"].where("object_type = 'node' AND object_id = 'h'").isEmpty()  # merged before
    back = ledger.split_duplicates(after, after["changes"])
    for name in ("nodes", "aliases", "tags"):
        assert rows_of(back[name]) == rows_of(state[name])
    assert {r.conflict_id: r.status for r in back["conflicts"].collect()} == {"1": "open", "2": "resolved", "3": "open", "4": "acknowledged", "5": "open"}


def test_a_chosen_node_stays(spark, state):
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "keep_id string, id string")
    after = ledger.merge_duplicates(state, links, chosen=spark.createDataFrame([("c",), ("q",)], "id string"))
    assert {r.id for r in after["nodes"].where("status = 'merged' AND id != 'h'").collect()} == {"a", "b"}
    assert {r.alias for r in after["aliases"].where("node_id = 'c'").collect()} == {"first", "second", "third", "a", "b", "Name a", "Name b"}


def test_merge_without_links_changes_nothing(spark, state):
    after = ledger.merge_duplicates(state, spark.createDataFrame([], "keep_id string, id string"))
    assert after["changes"].isEmpty() and rows_of(after["nodes"]) == rows_of(state["nodes"])


def test_linked_classes_have_a_row_for_each_node(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "keep_id string, id string")
    assert sorted(tuple(r) for r in ledger.linked_classes(links).collect()) == [("a", "a", 1), ("b", "a", 2), ("c", "a", 1), ("x", "x", 1), ("y", "x", 1)]


# --- store and index -------------------------------------------------------------------------------------------


def files(path):
    return sorted((str(p.relative_to(path)), p.stat().st_mtime_ns) for p in path.rglob("*") if p.is_file())


@pytest.fixture
def docs(spark):
    rows = [(i, "Title of all" if i % 3 else "Rare heading", "", f"alpha beta{i} " + "gamma " * (i % 7)) for i in range(200)]
    return spark.createDataFrame([*rows, (500, None, None, None), (501, "", "", "")], "doc_id long, title string, section string, text string")


def test_a_second_run_writes_nothing(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index", 8)
    assert {r.state for r in text_index.update(store, docs, text_index.as_they_are).collect()} == {"new"}
    before = files(tmp_path)
    again = text_index.update(Store(spark, f"file://{tmp_path}/index"), docs, text_index.as_they_are)
    assert {r.state for r in again.collect()} == {"unchanged"} and again.count() == 202
    assert files(tmp_path) == before and store.last_commit()["number"] == 1


def test_only_touched_buckets_are_written(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index", 8)
    text_index.update(store, docs, text_index.as_they_are)
    old = store.last_commit()
    changed = docs.where("doc_id != 4").withColumn("text", F.when(F.col("doc_id") == 3, "delta").otherwise(F.col("text")))
    states = {r.doc_id: r.state for r in text_index.update(store, changed, text_index.as_they_are).where("state != 'unchanged'").collect()}
    assert states == {3: "changed", 4: "gone"}
    new = store.last_commit()
    touched = {str(r[0]) for r in docs.where("doc_id IN (3, 4)").select(store.bucket_of(F.col("doc_id"))).collect()}
    for table in ("chunks", "documents", "blocks", "totals"):
        was, now = old["tables"][table]["versions"], new["tables"][table]["versions"]
        assert {b for b in was if was[b] != now.get(b)} == touched
    assert rows_of(store.read("chunks").select("doc_id", "title", "section", "text")) == rows_of(changed)
    assert rows_of(store.read("chunks", old).select("doc_id", "title", "section", "text")) == rows_of(docs)  # a reader of the old commit
    assert store.forget_old() > 0
    assert rows_of(store.read("chunks").select("doc_id", "title", "section", "text")) == rows_of(changed)
    text_index.update(store, docs.where("false"), text_index.as_they_are, prune=False)
    assert store.last_commit()["number"] == new["number"]
    text_index.update(store, docs.where("false"), text_index.as_they_are)
    assert store.read("chunks").count() == 0 and store.read("documents").count() == 0


def test_of_two_writers_the_second_fails(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index", 4)
    text_index.update(store, docs, text_index.as_they_are)
    last, version = store.begin()
    store.stage("documents", version, store.read("documents", last, [0]).limit(0), ["doc_id"])
    text_index.update(Store(spark, f"file://{tmp_path}/index"), docs.where("doc_id > 10"), text_index.as_they_are)
    with pytest.raises(Conflict):
        store.commit(last, version, [0])
    assert store.read("documents").count() == 191


def plain_scores(rows, queries, weights):
    """BM25 with weighted fields, all documents against all queries."""
    import math
    import re

    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    held = {d: [words(t) for t in fields] for d, *fields in rows}
    mean = sum(sum(map(len, f)) for f in held.values()) / len(held)
    out = {}
    for q, text in queries:
        terms = list(dict.fromkeys(words(text)))
        for d, fields in held.items():
            score = 0.0
            for t in terms:
                tf = sum(w * f.count(t) for w, f in zip(weights, fields))
                df = sum(any(t in f for f in other) for other in held.values())
                length = sum(map(len, fields))
                score += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
            if score > 0:
                out[q, d] = round(score, 6)
    return out


def test_search_opens_few_ranges_and_finds_the_best(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RANGE", 5)
    store = Store(spark, f"file://{tmp_path}/index", 8)
    text_index.update(store, docs, text_index.as_they_are)
    queries = [(1, "rare gamma"), (2, "beta17 alpha"), (3, "nowhere"), (4, "title alpha gamma gamma")]
    opened = []
    real = text_index.open_ranges
    monkeypatch.setattr(text_index, "open_ranges", lambda bounds, floor: opened.append((bounds.where("query_id = 2").count(), real(bounds, floor).where("query_id = 2").count())) or real(bounds, floor))
    weights = {"title": 3.0, "section": 2.0}
    got = text_index.search(store, spark.createDataFrame(queries, "query_id long, text string"), 1, weights).collect()
    want = plain_scores([tuple(r) for r in docs.collect()], queries, (3.0, 2.0, 1.0))
    for q, _ in queries:
        ranked = sorted((-s, d) for (p, d), s in want.items() if p == q)[:1]
        assert [(-round(r.score, 6), r.doc_id) for r in got if r.query_id == q] == ranked
    rest, open_ = opened[0]
    assert open_ < rest  # one document holds the word; the ranges without it are below its score
    monkeypatch.setattr(text_index, "open_ranges", real)
    many = text_index.search(store, spark.createDataFrame(queries, "query_id long, text string"), 500, weights).collect()
    assert {(r.query_id, r.doc_id): round(r.score, 6) for r in many} == want


def test_search_of_the_store_equals_the_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    store = Store(spark, f"file://{tmp_path}/index", 4)
    text_index.update(store, docs.select("doc_id", F.lit("").alias("title"), F.lit("").alias("section"), "text"), text_index.as_they_are)
    q = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    want = retrieval.top_k(retrieval.bm25(docs, q, "doc_id", "text"), 10)
    row = lambda r: (r.query_id, r.doc_id, round(r.score, 6), r["rank"])
    assert sorted(map(row, text_index.search(store, q, 10).collect())) == sorted(map(row, want.collect()))


def test_documents_are_chunked_into_the_store(spark, tmp_path):
    rows = [(1, "Note", "# Head\n\nalpha beta\n\n## Two\n\ngamma", "markdown"), (2, "Empty", "", "plain"), (3, "Plain", "one. two. three.", "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, strategy string")
    store = Store(spark, f"file://{tmp_path}/index", 4)
    text_index.update(store, docs)
    chunks = store.read("chunks").collect()
    assert {r.doc_id for r in chunks} == {1, 3} and {r.doc_id for r in store.read("documents").collect()} == {1, 2, 3}
    hits = text_index.search(store, spark.createDataFrame([(1, "gamma"), (2, "note")], "query_id long, text string"), 3).collect()
    assert {(r.query_id, r.doc_id.split(":")[1]) for r in hits} == {(1, "1"), (2, "1")}
    assert {r.state for r in text_index.update(store, docs).collect()} == {"unchanged"}


# --- texts that hold a string ----------------------------------------------------------------------------------


def test_containing_equals_a_scan_of_all_pairs(spark):
    rnd = random.Random(8)
    letters = "abcé. -"
    texts = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(25)))) for i in range(120)] + [(500, None), (501, ""), (502, "  "), (503, "x\ny z")]
    probes = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7))) for _ in range(150)} | {"", " ", "y z", "x\ny", "nowhere at all"}
    got = matching.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in sorted(probes)] + [(None,)], "probe string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, p) for i, t in texts for p in probes if t and p.strip() and p in t)
    none = spark.createDataFrame([], "probe string")
    assert matching.containing(spark.createDataFrame(texts, "id long, text string"), none).isEmpty()


def test_hints_and_scores_meet_by_words(spark):
    """No plan of node hints or graph scores pairs all rows of two tables."""
    from siltstone.plans.registry import QUERIES

    for name in ("J03_node_hints", "J04_graph_score"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbered_names_of_other_kinds_do_not_meet_in_all_pairs(spark):
    """Pairs of letters are shared by many numbers; pieces with their place are not, so candidates grow with the texts."""
    numbered = lambda name, side, n: spark.range(n).select(F.format_string(f"{name} %09d", F.col("id") * 7).alias(side)).withColumn(f"{side}_n", F.length(side))
    lengths = spark.createDataFrame([(16, 18, 16, 0, 2)], "left_n int, right_n int, least int, left_gone int, right_gone int")
    for n in (500, 2000):
        assert matching.pieces_met({"left": numbered("nobody", "left", n), "right": numbered("customer", "right", n)}, lengths, []).count() <= 30 * n


def test_forms_of_stored_texts_are_merged(spark):
    """Stored texts look small; their forms, many times as large, must not be broadcast through the driver."""
    texts = spark.range(300).select(F.format_string("customer %09d", "id").alias("text"))
    plan = matching.matching_texts(texts, texts, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [form" in plan and "BroadcastHashJoin [form" not in plan


def test_graph_scores_cover_every_query_and_chunk(spark):
    """Chunks without a hint of a query score 0 and have a row, over several parts and blocks too."""
    from siltstone.operators import retrieval
    from siltstone.plans.registry import QUERIES

    got = QUERIES["J04_graph_score"](spark, DATA)
    chunks = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").distinct().count()
    assert got.count() == chunks * got.select("query_id").distinct().count() and got.where("graph = 0").count() > 0
    ids = spark.range(50).withColumnRenamed("id", "chunk_id")
    asked = spark.range(7).withColumnRenamed("id", "query_id")
    some = spark.createDataFrame([(q, c, 0.1 + q) for q in range(6) for c in range(q, 50, 9)], "query_id long, chunk_id long, graph double")
    rows = retrieval.scored_everywhere(some, ids, asked, "graph", part_rows=9, block=2).collect()
    assert sorted(tuple(r) for r in rows) == [(q, c, 0.1 + q if q < 6 and c >= q and (c - q) % 9 == 0 else 0.0) for q in range(7) for c in range(50)]


def test_an_unfinished_commit_is_passed_over(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index", 2)
    text_index.update(store, docs, text_index.as_they_are)
    (tmp_path / "index" / "commits" / "000000000002.json").write_text('{"number": 2, "tab')
    assert store.last_commit()["number"] == 1 and store.read("chunks").count() == 202
    with pytest.raises(Conflict):
        text_index.update(store, docs.where("doc_id > 3"), text_index.as_they_are)


def test_blocks_of_one_bucket_need_no_large_task(spark, docs, tmp_path, monkeypatch):
    """A bucket is written by several tasks, kept chunks beside new ones, and blocks are built where chunks lie."""
    monkeypatch.setattr(text_index, "PIECE_BYTES", 256)
    monkeypatch.setattr(text_index, "RANGE_TOKENS", 20)
    store = Store(spark, f"file://{tmp_path}/index", 1)
    text_index.update(store, docs, text_index.as_they_are)
    changed = docs.where("doc_id != 4").withColumn("text", F.when(F.col("doc_id") == 3, "delta").otherwise(F.col("text")))
    text_index.update(store, changed, text_index.as_they_are)
    version = store.last_commit()["tables"]["chunks"]["versions"]["0"]
    assert len(list((tmp_path / "index" / "chunks" / f"stored_version={version}" / "bucket=0").glob("*.parquet"))) > 4
    assert rows_of(store.read("chunks").select("doc_id", "title", "section", "text")) == rows_of(changed)
    plan = text_index.posting_blocks(store.read("chunks"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    queries = [(1, "rare gamma"), (2, "beta17 alpha"), (3, "nowhere"), (4, "delta")]
    got = text_index.search(store, spark.createDataFrame(queries, "query_id long, text string"), 500).collect()
    assert {(r.query_id, r.doc_id): round(r.score, 6) for r in got} == plain_scores([tuple(r) for r in changed.collect()], queries, (1.0, 1.0, 1.0))


def test_scores_by_cells_equal_the_plain_ones(spark, docs):
    """Several parts and blocks; pairs of query and document are summed in their cell, not shuffled to their sums."""
    rows = [r for r in docs.select("doc_id", "text").collect()]
    queries = [(1, "alpha gamma"), (2, "beta17 alpha"), (3, "nowhere"), (4, ""), (5, None), (6, "beta3 beta4 gamma gamma")]
    hits = retrieval.bm25(docs, spark.createDataFrame(queries, "query_id long, text string"), "doc_id", "text", part_rows=30, block=2)
    want = plain_scores([(r.doc_id, r.text) for r in rows], queries, (1.0,))
    assert {(r.query_id, r.doc_id): round(r.score, 6) for r in hits.collect()} == want
    assert "FlatMapCoGroupsInArrow" in hits._jdf.queryExecution().executedPlan().toString()


def test_ranks_over_parts_equal_those_of_whole_lists(spark):
    """A list falls into several parts, and a part holds several lists; ties go by id, and no window runs over a whole list."""
    rows = [(q, d, float(d * 7 % 5)) for q in range(4) for d in range(50 * q + 1)]
    hits = spark.createDataFrame(rows, "query_id long, doc_id long, score double")
    got = retrieval.reciprocal_rank(hits, part_rows=40)
    want = {}
    for q in range(4):
        for i, (_, d) in enumerate(sorted((-s, d) for p, d, s in rows if p == q), 1):
            want[q, d] = round(1 / i, 9)
    assert {(r.query_id, r.doc_id): round(r.rr, 9) for r in got.collect()} == want and got.count() == len(rows) and got.columns == [*hits.columns, "rr"]


def plans_of(spark, since):
    """The plans that ran after some execution, as text."""
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [x.physicalPlanDescription() for x in (listed.apply(i) for i in range(listed.size())) if x.executionId() > since]


def last_execution(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    return listed.last().executionId() if listed.size() else -1


def test_blocks_are_written_as_they_come(spark, docs, tmp_path, monkeypatch):
    """Blocks are many times the bytes of their texts: no task sorts them, and a task with several buckets writes each to its own file."""
    monkeypatch.setattr(text_index, "RANGE", 5)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before, since = spark.conf.get(key), last_execution(spark)
    store = Store(spark, f"file://{tmp_path}/index", 8)
    text_index.update(store, docs.coalesce(1), text_index.as_they_are)
    assert spark.conf.get(key) == before
    last_execution(spark)
    (plan,) = [x for x in plans_of(spark, since) if "MapInArrow" in x and "InsertIntoHadoopFsRelation" in x]
    assert "Sort" not in plan
    blocks = store.read("blocks").collect()
    assert len({r.bucket for r in blocks}) == 8 and len({(r.bucket, r.range, r.term) for r in blocks}) == len(blocks)
    assert {(r.term, p.chunk_id) for r in blocks for p in r.postings if r.term.startswith("beta")} == {(f"beta{i}", i) for i in range(200)}
    bucket = {r.doc_id: r.bucket for r in store.read("chunks").collect()}
    assert all(bucket[p.chunk_id] == r.bucket for r in blocks for p in r.postings)
    for of_range in {(r.bucket, r.range) for r in blocks}:
        terms = [r.term for r in blocks if (r.bucket, r.range) == of_range]
        assert terms == sorted(terms)


def test_a_failing_write_leaves_the_setting_as_it_was(spark, docs, tmp_path):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    store = Store(spark, f"file://{tmp_path}/index", 4)
    _, version = store.begin()
    with pytest.raises(Exception, match="odd row"):
        store.stage("rows", version, docs.select(F.raise_error(F.lit("odd row")).cast("string").alias("x"), F.lit(0).alias("bucket")), [])
    assert spark.conf.get(key) == before


def test_scores_of_chunks_are_summed_in_their_ranges(spark, docs, tmp_path, monkeypatch):
    """Pairs of query and chunk are many; they stay in the cell of their range, which leaves the best of each query, ties by id and queries in several blocks."""
    monkeypatch.setattr(text_index, "RANGE", 5)
    monkeypatch.setattr(text_index, "BLOCK", 2)
    store = Store(spark, f"file://{tmp_path}/index", 8)
    text_index.update(store, docs, text_index.as_they_are)
    queries = [(1, "rare gamma"), (2, "beta17 alpha"), (3, "nowhere"), (4, "title alpha gamma gamma"), (5, ""), (6, "beta9 beta40 nowhere")]
    asked = spark.createDataFrame([*queries, (7, None)], "query_id long, text string")
    want = plain_scores([tuple(r) for r in docs.collect()], queries, (0.0, 2.0, 1.0))
    # a word that weighs nothing is still met
    want |= {(q, r.doc_id): want.get((q, r.doc_id), 0.0) for r in docs.collect() for q, word in ((1, "Rare"), (4, "Title")) if word in (r.title or "")}
    for k in (1, 3, 500):
        hits = text_index.search(store, asked, k, {"title": 0.0, "section": 2.0})
        ranked = {q: sorted((-s, d) for (p, d), s in want.items() if p == q)[:k] for q, _ in queries}
        got = {(r.query_id, r["rank"]): (-round(r.score, 6), r.doc_id) for r in hits.collect()}
        assert got == {(q, i): x for q, of in ranked.items() for i, x in enumerate(of, 1)}
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "explode(postings" not in plan


def test_ids_that_come_again_and_null_ids_sum_over_ranges(spark, tmp_path, monkeypatch):
    """Ids should be unique; rows of one id count together all the same, in several ranges too."""
    monkeypatch.setattr(text_index, "RANGE", 3)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "", None, None if i == 5 else "alpha " * (i % 4) + f"beta gamma{i % 5}") for i in range(30)]
    store = Store(spark, f"file://{tmp_path}/index", 1)
    text_index.update(store, spark.createDataFrame(rows, "doc_id long, title string, section string, text string").coalesce(1), text_index.as_they_are)
    queries = [(1, "alpha beta"), (2, "gamma3"), (3, "beta gamma1 gamma2")]
    want = {}
    for (q, i), s in plain_scores([(i, *r[1:]) for i, r in enumerate(rows)], queries, (1.0, 1.0, 1.0)).items():
        want[q, rows[i][0]] = want.get((q, rows[i][0]), 0.0) + s
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = text_index.search(store, asked, 500, first=1000).collect()
    assert {(r.query_id, r.doc_id): round(r.score, 4) for r in got} == {x: round(s, 4) for x, s in want.items()} and len(got) == len(want)
    best = text_index.search(store, asked, 1, first=1000).collect()
    assert {r.query_id: round(r.score, 4) for r in best} == {q: round(max(s for (p, _), s in want.items() if p == q), 4) for q, _ in queries}


def test_a_task_gets_one_piece(spark, tmp_path):
    """However pieces are numbered, none share a task; what is grouped by bucket, piece and key isn't moved again."""
    store = Store(spark, f"file://{tmp_path}/index", 4)
    rows = spark.range(2000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("doc_id")).withColumn("bucket", store.bucket_of(F.col("doc_id")))
    dealt = store.deal(rows, F.col("doc_id"), 8)
    places = dealt.select("bucket", "piece", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(places) == len({r.piece for r in places}) == len({r.task for r in places}) == 32 and dealt.count() == 2000
    assert {r.piece // 8 for r in places if r.bucket == 3} == {3}
    last = F.max("doc_id").over(Window.partitionBy("bucket", "piece", "doc_id"))
    for grouped in (dealt.withColumn("last", last), dealt.dropDuplicates(["bucket", "piece", "doc_id"])):
        assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
