"""Shortest paths from both ends, against the search from one end."""

import random

import pytest

from siltstone.operators import graph


def plain_path(edges, start, end, most):
    """The least of the shortest paths, by levels from the start."""
    level = {start: (start,)}
    seen = dict(level)
    for _ in range(most + 1):
        if end in level:
            return level[end]
        found = {}
        for x, path in level.items():
            for a, b in edges:
                if a == x and b not in seen and (b not in found or path + (b,) < found[b]):
                    found[b] = path + (b,)
        level = found
        seen |= found
    return None


@pytest.mark.parametrize("seed", range(5))
def test_paths_equal_the_search_from_one_end(spark, seed):
    rnd = random.Random(seed)
    edges = {(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(45)}
    if seed % 2:
        edges |= {(b, a) for a, b in edges}  # undirected, as the graph's adjacency is
    df = spark.createDataFrame(sorted(edges), "a string, b string")
    for _ in range(3):
        start, end = f"n{rnd.randrange(25)}", f"n{rnd.randrange(26)}"
        got = [(r.id, r.depth, tuple(r.path)) for r in graph.find_path(df, start, end, 4).collect()]
        want = plain_path(edges, start, end, 4)
        assert got == ([(end, len(want) - 1, want)] if want and len(want) <= 5 else [])
        one_way = [(r.id, r.depth, tuple(r.path)) for r in graph.distances(df, start, 4).where(f"id = '{end}'").collect()]
        assert got == one_way or (start == end and got == [(end, 0, (start,))])


def test_a_hub_is_not_expanded(spark):
    """The goal hangs on a hub; from the goal's end the hub is met by one edge, from the start it would be expanded."""
    edges = [("s", "x"), ("x", "hub"), ("hub", "goal")] + [("hub", f"leaf{i}") for i in range(3000)]
    edges += [(b, a) for a, b in edges]
    df = spark.createDataFrame(edges, "a string, b string")
    expanded = []
    assert graph.find_path(df, "s", "goal", 4, expanded).first().path == ["s", "x", "hub", "goal"]
    assert sum(expanded) < 10
    assert graph.find_path(df, "s", "nowhere", 4).isEmpty() and graph.find_path(df, "s", "goal", 2).isEmpty()
