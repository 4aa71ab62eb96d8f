"""Nearest vectors from cells, against all pairs."""

import numpy as np
import pytest

from siltstone.operators import vector_index


def all_pairs(rows, queries, k):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1.0)
    out = set()
    for q, v in queries:
        if v:
            scored = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, w in rows if w)
            out |= {(q, i, r) for r, (_, i) in enumerate(scored[:k], 1)}
    return out


def frames(spark, rows, queries):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame(queries, "query_id long, vector array<float>")


@pytest.mark.parametrize("k", [1, 5, 400])
def test_nearest_equals_all_pairs_and_opens_few_cells(spark, monkeypatch, k):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 100)
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 12] + rng.normal(size=8) * 0.1]) for i in range(600)]
    rows += [(700, [0.0] * 8), (701, []), (702, None), (703, rows[5][1]), (704, rows[5][1])]
    queries = [(q, rows[q * 13][1]) for q in range(30)] + [(90, [0.0] * 8), (91, [])]
    seen = []
    real = vector_index.cells_left
    monkeypatch.setattr(vector_index, "cells_left", lambda cells, floor: seen.append((cells.count(), real(cells, floor).count())) or real(cells, floor))
    vectors, asked = frames(spark, rows, queries)
    got = {(r.query_id, r.doc_id, r["rank"]) for r in vector_index.nearest(vector_index.build_index(vectors), asked, k).collect()}
    assert got == all_pairs(rows, queries, k)
    if k == 1:
        assert seen[0][1] < 0.5 * seen[0][0]


def test_an_index_of_nothing(spark):
    vectors, _ = frames(spark, [(1, []), (2, None)], [])
    assert vector_index.build_index(vectors) is None
