"""Steps whose tasks must not grow with their input: the same rows as a plain version, from plans and tasks that stay small."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone import batches
from siltstone.functions import text as T
from siltstone.operators import governance, graph, vector_index


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anchors_meet_requests_where_they_lie(spark):
    rows = [
        ("a5", "active", "*", "*"), ("a6", "active", "*", "*"), ("a4", "active", "buy", "*"), ("a3", "active", "*", "c1"), ("a7", "active", "buy", "c2"), ("a1", "draft", "buy", "c1"),
        ("a2", "active", "sell", "*"), ("a0", "active", None, "c1"), ("a9", "active", "buy", None),
    ]
    anchors = spark.createDataFrame(rows, "anchor_id string, status string, scope_claim_type string, scope_client_id string")
    asked = [(1, "buy", "c1"), (1, "look", "c9"), (2, "buy", "c2"), (3, "sell", "c1"), (4, None, "c1"), (5, "buy", None), (6, None, None), (None, "buy", "c9"), (7, "*", "c1")]
    requests = spark.createDataFrame(asked, "request_id long, claim_type string, client_id string")

    def best(kind, client):
        live = [(-((t != "*") + (c != "*")), i) for i, s, t, c in rows if s == "active" and t in ("*", kind) and c in ("*", client) and None not in (t, c)]
        return min(live)[1] if live else None

    got = governance.matching_anchors(requests, anchors)
    assert sorted(map(str, ((r.request_id, r.claim_type, r.client_id, r.anchor_id) for r in got.collect()))) == sorted(map(str, ((i, t, c, best(t, c)) for i, t, c in asked)))
    assert got.columns == ["request_id", "claim_type", "client_id", "anchor_id", "scope_claim_type", "scope_client_id", "specificity"]
    none = governance.matching_anchors(requests, anchors.where("anchor_id = 'a7'"))
    assert {(r.request_id, r.anchor_id) for r in none.collect() if r.anchor_id} == {(2, "a7")} and none.count() == len(asked)
    # requests are neither dealt nor sorted by anything
    assert not re.findall(r"(hashpartitioning|Sort \[)[^\n]*(request_id|claim_type#|client_id#)", plan_of(got).replace("scope_claim_type", "").replace("scope_client_id", ""))


def test_a_query_leaves_a_part_of_the_vectors_with_its_best_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 16)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    seen, real = [], vector_index.top_k
    monkeypatch.setattr(vector_index, "top_k", lambda hits, k: seen.append(hits.count()) or real(hits, k))
    index = vector_index.build_index(vectors)
    assert vector_index.nearest(index, asked, 40).count() == 18 * 40
    assert seen[0] <= 18 * 40 and seen[1] <= 2 * 18 * 40  # not forty for each of some thirty cells


def test_first_of_rows():
    scores = np.array([[1.0, 3.0, 3.0, 3.0, -np.inf], [-np.inf, 0.5, -np.inf, 0.25, -np.inf]])
    rows, columns = vector_index.first_of_rows(scores, np.array([-np.inf, 0.3]), 2)
    assert list(zip(rows, columns)) == [(0, 1), (0, 2), (1, 1)]


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["x" * (3000 if i % 5 else 40) for i in range(999)] + ["y" * 90_000, None, ""]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts})
    parts = list(batches.slices(batch, 64, 50_000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows <= 64 and (p.nbytes <= 50_000 or p.num_rows == 1) for p in parts)


def test_rows_are_found_across_slices(spark):
    rows = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('word ', 4000) AS text")

    def found(some):
        n = 0
        for i, text in some:
            n += 1
            yield (i, len(text), [str(n)])

    got = batches.map_rows(rows, found, "id long, n int, tags array<string>")
    assert sorted((r.id, r.n, r.tags) for r in got.collect()) == [(i, 20_000, [str(i + 1)]) for i in range(400)]
    assert batches.map_rows(rows.where("id < 0"), found, "id long, n int, tags array<string>").count() == 0


def test_adjacency_reads_its_view_once_and_steps_take_repeated_edges(spark):
    view = spark.createDataFrame([("a", "r", "b"), ("a", "s", "b"), ("b", "r", "c")], "source_id string, relation string, target_id string")
    near = graph.adjacency(view)
    assert sorted(map(tuple, near.collect())) == [("a", "b", "r"), ("a", "b", "s"), ("b", "a", "r"), ("b", "a", "s"), ("b", "c", "r"), ("c", "b", "r")]
    assert "Union" not in plan_of(near)
    assert graph._salted(near).count() == 6  # not made distinct
    assert sorted((r.id, r.depth, r.path) for r in graph.distances(near, "a", 3).collect()) == [("a", 0, ["a"]), ("b", 1, ["a", "b"]), ("c", 2, ["a", "b", "c"])]


@pytest.mark.parametrize("small", [0, 100])
def test_no_frontier_is_broadcast_with_a_row_for_each_salt(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small, raising=False)
    edges = graph._salted(spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d")], "a string, b string"))
    frontier = graph.written(spark.createDataFrame([("b", ["a", "b"])], "id string, path array<string>"), "frontier")
    step = graph._step(frontier, edges, frontier, F.concat("path", F.array("b")))
    plan = plan_of(step)
    assert plan.count("BroadcastExchange") == (1 if small else 0) and ("Generate" in plan) == (not small)
    assert sorted(map(tuple, step.collect())) == [("c", ["a", "b", "c"]), ("d", ["a", "b", "d"])]


@pytest.mark.parametrize("small", [1, 10_000])
def test_distances_over_nodes_equal_those_over_live_edges(spark, monkeypatch, small):
    """Nodes are looked up where steps find them; ends that are dead or no nodes at all lead nowhere."""
    monkeypatch.setattr(graph, "SMALL", small, raising=False)
    rnd = random.Random(3)
    status = lambda: rnd.choice(["active", "active", "provisional", "merged"])
    nodes = spark.createDataFrame([(f"n{i}", f"N{i}", "t", "active" if i < 2 else "merged" if i == 2 else status()) for i in range(30)], "id string, name string, type string, status string")
    evidence = spark.createDataFrame([("e1", "active"), ("e2", "reverted")], "id string, status string")
    rows = [(f"n{rnd.randrange(34)}", "r", f"n{rnd.randrange(34)}", rnd.choice([None, None, "e1", "e2", "gone"]), status()) for _ in range(90)] + [(None, "r", "n0", None, "active"), ("n0", "r", None, None, None)]
    edges = spark.createDataFrame(rows, "source_id string, relation string, target_id string, evidence_id string, status string")
    live = nodes.where("status IN ('active', 'provisional')")
    found = lambda df: sorted(tuple(r) for r in df.collect())
    for start in ("n0", "n2", "n33", "nowhere"):
        got = found(graph.distances(graph.adjacency(graph.live_links(edges, evidence)), start, 3, live))
        assert got == found(graph.distances(graph.adjacency(graph.live_edges(graph.edge_view(edges, nodes, evidence))), start, 3))
        assert (len(got) > 1) == (start == "n0")


def test_of_nodes_that_hold_the_same_only_the_first_meet_queries(spark, monkeypatch):
    kinds = ["account", "tool", None]
    rows = [(f"n:{i:03}", f"Customer#{i % 90:03}", f"Customer in segment {'ABCD'[i % 4]}x", kinds[i % 3], "active" if i % 10 else "merged") for i in range(360)]
    rows += [("n:alpha", None, "segment one", "tool", "active"), ("n:beta", "alpha IN beta", None, "concept", "active"), ("n:beta", "other", "Alpha", "concept", "active"), ("n:x", "", "", None, "active")]
    nodes = spark.createDataFrame(rows, "id string, name string, summary string, type string, status string")
    asked = [(1, "in the segment bx"), (2, "alpha in in beta"), (3, "Customer#04"), (4, ""), (5, None), (6, "  "), (7, "n:01"), (8, "nowhere at"), (9, "IN")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    tokens = {r[0]: r[1] for r in queries.select("query_id", T.fts_terms(queries["text"], 8)).collect()}
    want = []
    for q, text in asked:
        found = []
        for i, *texts, kind, status in rows:
            name, summary = ((x or "").lower() for x in texts)
            held = lambda w, *where: any(w in x for x in where)
            probes = [text.lower(), *tokens[q]] if text and text.strip() else []
            if status == "active" and any(held(w, name, summary) for w in probes):
                score = 8.0 * held(text.lower(), name, i) + sum(2.0 * held(w, name, i) + 0.5 * held(w, summary) for w in tokens[q]) + 0.4 * (kind in ("tool", "concept"))
                found.append((-score, kind or "", texts[0] or "", i))
        want += [(q, i, -s, at) for at, (s, _, _, i) in enumerate(sorted(found)[:3], 1)]
    seen, real = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: seen.setdefault(label, real(df, label)))
    got = graph.node_hints(nodes, queries, 3)
    assert sorted((r.query_id, r.node_id, r.score, r["rank"]) for r in got.collect()) == sorted(want)
    assert {q for q, *_ in want} == {1, 2, 3, 7, 9}
    assert seen["nodes"].count() <= 110  # of 328 live ones
