"""The property graph: visible edges, adjacency, search, bounded paths, statistics and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import checkpointed, written
from .matching import containing

CONFIDENCE_RANK = {"high": 0.0, "medium": 1.0, "low": 2.0}


def edge_view(edges: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges with the names and statuses of both ends and of their evidence (which may be absent)."""
    end = lambda side: nodes.select(
        F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("type").alias(f"{side}_type"), F.col("status").alias(f"{side}_status")
    )
    ev = evidence.select(F.col("id").alias("evidence_id"), F.col("status").alias("evidence_status"))
    return edges.join(end("source"), "source_id").join(end("target"), "target_id").join(ev, "evidence_id", "left")


def live_edges(view: DataFrame) -> DataFrame:
    """Edges that are live with both ends and their evidence, absent evidence allowed."""
    live = T.is_live
    return view.where(
        live(F.col("status")) & live(F.col("source_status")) & live(F.col("target_status")) & (F.col("evidence_id").isNull() | live(F.col("evidence_status")))
    )


def live_links(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges that are live with their evidence, absent evidence allowed, whatever their ends are."""
    ev = evidence.select(F.col("id").alias("evidence_id"), F.col("status").alias("evidence_status"))
    found = edges.where(T.is_live(F.col("status"))).join(ev, "evidence_id", "left")
    return found.where(F.col("evidence_id").isNull() | T.is_live(F.col("evidence_status")))


def incident(view: DataFrame, node: str, direction: str = "both", relation: str | None = None) -> DataFrame:
    side = {"out": F.col("source_id") == node, "in": F.col("target_id") == node}
    hit = side["out"] | side["in"] if direction == "both" else side[direction]
    return view.where(hit & (F.col("relation") == relation if relation else F.lit(True)))


def adjacency(view: DataFrame) -> DataFrame:
    """Undirected adjacency (a, b, relation): every edge in both directions."""
    ways = [F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "relation") for x, y in (("source_id", "target_id"), ("target_id", "source_id"))]
    return view.select(F.inline(F.array(*ways)))  # of one reading of the view


SALTS = 16
#: Rows of a frontier that is broadcast.
SMALL = 10_000


def _salted(adjacent: DataFrame) -> DataFrame:
    """Edges, written, with a salt by which a hub's edges are dealt to several tasks; edges that stand several times are as one to a step, which keeps a path for each node."""
    return written(adjacent.select("a", "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")), "edges")


def _met(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that leave a frontier, with its columns.

    A small frontier is broadcast, and edges stay where they are. Others look small as they are stored, without a row for each salt, and are never
    broadcast; a task holds its part of them.
    """
    if frontier.count() <= SMALL:
        return F.broadcast(frontier).join(edges.drop("salt"), F.col("id") == F.col("a"))
    spread = frontier.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("shuffle_hash")
    return spread.join(edges, (spread["id"] == edges["a"]) & (spread["salt"] == edges["salt"]))


def _step(frontier: DataFrame, edges: DataFrame, seen: DataFrame, extend) -> DataFrame:
    """(id, path) of the nodes next to a frontier that weren't seen before, each with its least path."""
    step = _met(frontier, edges).select(F.col("b").alias("id"), extend.alias("path"))
    return step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id").hint("merge"), "id", "left_anti")


def distances(adjacent: DataFrame, start: str, max_depth: int = 4, nodes: DataFrame | None = None) -> DataFrame:
    """(id, depth, path) of the nodes reachable within ``max_depth`` steps, each at its first depth; only over the ids of ``nodes``, where given.

    Every step joins only the newest frontier and drops nodes seen before; of equal paths the least stays.
    Each frontier is written, so the plan doesn't grow. The nodes that a step finds are looked up in ``nodes``, not both ends of all edges.
    """
    frontier = adjacent.sparkSession.createDataFrame([(start, 0, [start])], "id string, depth int, path array<string>")
    if nodes is not None and nodes.where(F.col("id") == start).isEmpty():
        return frontier
    edges = _salted(adjacent)
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = _step(frontier, edges, seen, F.concat("path", F.array("b")))
        step = step if nodes is None else step.join(nodes.select("id").hint("merge"), "id", "left_semi")
        frontier = written(step.select("id", F.lit(depth).alias("depth"), "path"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def _degrees(frontier: DataFrame, degrees: DataFrame) -> int:
    """Edges that leave a frontier."""
    ids = frontier.select("id")
    ids = F.broadcast(ids) if ids.count() <= SMALL else ids.hint("merge")
    return degrees.join(ids, "id").agg(F.sum("n")).first()[0] or 0


def find_path(adjacent: DataFrame, start: str, end: str, max_depth: int = 4, expanded: list[int] | None = None) -> DataFrame:
    """(id, depth, path): the shortest path from ``start`` to ``end``, of equal ones the least; no row where it takes more than ``max_depth`` steps.

    Frontiers grow from both ends, each time the one with fewer edges, so a hub near one end is reached from the other. They first meet in
    the two newest frontiers, at the length of the shortest path. ``expanded`` collects the number of edges of each step.
    """
    spark = adjacent.sparkSession
    schema = "id string, path array<string>"
    if start == end or max_depth < 1:
        rows = [(end, 0, [start])] if start == end else []
        return spark.createDataFrame(rows, "id string, depth int, path array<string>")
    ahead = _salted(adjacent)
    back = _salted(adjacent.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = []
    for edges, node, extend in ((ahead, start, F.concat("path", F.array("b"))), (back, end, F.concat(F.array("b"), "path"))):
        frontier = spark.createDataFrame([(node, [node])], schema)
        degrees = written(edges.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")), "degrees")
        sides.append({"edges": edges, "degrees": degrees, "frontier": frontier, "seen": frontier, "extend": extend})
    for depth in range(1, max_depth + 1):
        sizes = [_degrees(x["frontier"], x["degrees"]) if x.get("size") is None else x["size"] for x in sides]
        if not min(sizes):  # an end with no way on
            break
        for x, n in zip(sides, sizes):
            x["size"] = n
        grown = sides[0] if sizes[0] <= sizes[1] else sides[1]
        if expanded is not None:
            expanded.append(grown["size"])
        grown["frontier"] = written(_step(grown["frontier"], grown["edges"], grown["seen"], grown["extend"]), "frontier")
        grown["seen"], grown["size"] = grown["seen"].unionByName(grown["frontier"]), None
        left, right = sides[0]["frontier"], sides[1]["frontier"].withColumnRenamed("path", "rest")
        met = left.join(right.hint("merge"), "id").select(F.concat("path", F.slice("rest", 2, max_depth + 1)).alias("path"))
        best = written(met.agg(F.min("path").alias("path")).where("path IS NOT NULL"), "path")
        if not best.isEmpty():
            return best.select(F.lit(end).alias("id"), F.lit(depth).alias("depth"), "path")
    return spark.createDataFrame([], "id string, depth int, path array<string>")


def escaped_like(term: str) -> str:
    """A LIKE pattern that holds a term literally."""
    return "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def search_nodes(nodes: DataFrame, aliases: DataFrame, tags: DataFrame, term: str, limit: int = 20, include_inactive: bool = False) -> DataFrame:
    """Nodes whose name, summary, an alias or a tag holds the term."""
    like = escaped_like(term.lower())
    has = lambda c: F.lower(c).like(like)
    by_alias = aliases.where(has("alias")).select(F.col("node_id").alias("id"))
    by_tag = tags.where(has("tag")).select(F.col("node_id").alias("id"))
    by_self = nodes.where(has("name") | has("summary")).select("id")
    found = nodes.join(by_self.union(by_alias).union(by_tag).distinct(), "id", "left_semi")
    found = found if include_inactive else found.where(T.is_live(F.col("status")))
    return found.orderBy("type", "name", "id").limit(limit)


def resolve_node(nodes: DataFrame, aliases: DataFrame, value: str) -> DataFrame:
    """The best node for an id, a name, an exact alias or a part of a name, in this order."""
    low, like = value.lower(), escaped_like(value.lower())
    named = nodes.select("id", "type", "name", "status", F.col("name").alias("key"))
    other = nodes.join(aliases, nodes["id"] == aliases["node_id"]).select("id", "type", "name", "status", F.col("alias").alias("key"))
    rank = F.when((F.col("id") == value) | (F.lower("key") == low), 0).when(F.lower("key").like(like), 1).otherwise(2)
    rows = named.unionByName(other).where(T.is_live(F.col("status"))).withColumn("rank", rank).where("rank < 2")
    return rows.orderBy("rank", "type", "name", "id").limit(1).select("id", "type", "name", "rank")


def hint_scores(nodes: DataFrame, query: str, tokens: list[str], limit: int = 8) -> DataFrame:
    """Graph hints for a query: 8 for the query in name or id, 2 and .5 for each token, .4 for four types."""
    name, key, summary = F.lower("name"), F.lower("id"), F.lower("summary")
    has = lambda c, w: F.contains(c, F.lit(w))
    q = query.lower()
    score = F.when(has(name, q) | has(key, q), 8.0).otherwise(0.0)
    for w in tokens:
        score = score + F.when(has(name, w) | has(key, w), 2.0).otherwise(0.0) + F.when(has(summary, w), 0.5).otherwise(0.0)
    score = score + F.when(F.col("type").isin("runtime", "tool", "concept", "failure_mode"), 0.4).otherwise(0.0)
    hit = F.lit(False)
    for w in [q, *tokens[:8]]:
        hit = hit | has(name, w) | has(summary, w)
    rows = nodes.where(T.is_live(F.col("status")) & hit).withColumn("score", score)
    return rows.orderBy(F.col("score").desc(), "type", "name", "id").limit(limit)


def node_hints(nodes: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, node_id, name, type, score): the best graph hints of each query (query_id, text), scored as in ``hint_scores``.

    A query meets the nodes whose name, id or summary holds its text or one of its tokens, by ``containing``. Nodes of a type that hold the same of
    all these strings in the same places have the same score for every query, so of each such class only the first ``limit`` by name and id meet
    queries; the others are left in the tasks that find them, and pairs of query and node are never moved for all nodes.
    """
    q = queries.select("query_id", F.lower("text").alias("q"), T.fts_terms(F.col("text"), 8).alias("tokens"))
    live = nodes.where(T.is_live(F.col("status"))).select("id", "name", "type", *(F.lower(c).alias(f"_{c}") for c in ("id", "name", "summary")))
    named = lambda w: F.contains(F.col("_name"), w) | F.contains(F.col("_id"), w)
    told = lambda w: F.contains(F.col("_summary"), w)
    each = F.aggregate("tokens", F.lit(0.0), lambda s, w: s + F.when(named(w), 2.0).otherwise(0.0) + F.when(told(w), 0.5).otherwise(0.0))
    hit = F.contains("_name", "q") | told(F.col("q")) | F.exists("tokens", lambda w: F.contains(F.col("_name"), w) | told(w))
    four = F.when(F.col("type").isin("runtime", "tool", "concept", "failure_mode"), 0.4).otherwise(0.0)
    probes = written(q.select("query_id", F.explode(F.array_union(F.array("q"), "tokens")).alias("probe")), "probes")
    texts = live.select("id", F.concat_ws("\n", "_name", "_id", "_summary").alias("text"))
    held = containing(texts, probes).groupBy("id").agg(F.array_sort(F.collect_set("probe")).alias("held"))
    places = F.transform("held", lambda w: F.struct(w.alias("probe"), F.contains("_name", w).alias("name"), F.contains("_id", w).alias("id"), told(w).alias("summary")))
    told_of = F.exists("places", lambda p: p["name"] | p["summary"])
    alike = Window.partitionBy("type", "places").orderBy("name", "id")
    first = live.join(held, "id").withColumn("places", places).where(told_of).withColumn("at", F.row_number().over(alike)).where(F.col("at") <= limit)
    first = written(first.drop("places", "at"), "nodes")
    met = first.select("id", F.explode("held").alias("probe")).join(probes, "probe").select("id", "query_id").distinct()
    rows = met.join(first.drop("held"), "id").join(q, "query_id").where(hit).withColumn("score", F.when(named(F.col("q")), 8.0).otherwise(0.0) + each + four)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "type", "name", "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", F.col("id").alias("node_id"), "name", "type", "score", "rank")


def library_nodes(tables: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Nodes of a library: for each type its rows and the columns of key, name and summary; ids are ``type:key``."""
    out = None
    for kind, (rows, key, name, summary) in tables.items():
        one = rows.select(
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"),
            F.coalesce(F.col(summary), F.lit("")).alias("summary"), F.lit("active").alias("status"), F.lit("medium").alias("confidence"),
        )
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["id"])


def library_edges(bridges: list[tuple[DataFrame, str, str, str, str, str]]) -> DataFrame:
    """Edges of bridge tables: (rows, source type, source column, relation, target type, target column), each once."""
    out = None
    for rows, source, source_key, relation, target, target_key in bridges:
        end = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
        one = rows.select(end(source, source_key).alias("source_id"), F.lit(relation).alias("relation"), end(target, target_key).alias("target_id"))
        out = one if out is None else out.unionByName(one)
    return out.where("source_id is not null and target_id is not null").distinct()


def counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def joined_tags(tags: DataFrame) -> DataFrame:
    return tags.distinct().groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))


def top_edges(view: DataFrame, limit: int) -> DataFrame:
    """Edges in export order: best confidence first."""
    rank = T.lookup(F.col("confidence"), CONFIDENCE_RANK, 3.0)
    return view.orderBy(rank, "relation", "source_id", "target_id").limit(limit)


def markdown_line() -> Column:
    return F.concat(F.lit("- `"), F.col("source_id"), F.lit("` --"), F.col("relation"), F.lit("--> `"), F.col("target_id"), F.lit("` ("), F.col("confidence"), F.lit(")"))


def mermaid(view: DataFrame, limit: int) -> DataFrame:
    """One row with a flow chart: the first edges by relation, source name and target name, nodes declared where first seen."""
    named = lambda c: F.when(F.substring(c, 1, 1).rlike("[0-9]"), F.concat(F.lit("n_"), c)).when(c == "", F.lit("node")).otherwise(c)
    safe = lambda c: named(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"))
    first = Window.orderBy("relation", "source_name", "target_name", "source_id", "target_id")
    rows = view.orderBy("relation", "source_name", "target_name", "source_id", "target_id").limit(limit).withColumn("at", F.row_number().over(first))  # at most ``limit`` rows
    end = lambda side, turn: F.struct(F.lit(turn).alias("turn"), F.col(f"{side}_id").alias("id"), F.col(f"{side}_name").alias("name"), F.col(f"{side}_type").alias("type"))
    ends = rows.select("at", F.explode(F.array(end("source", 0), end("target", 1))).alias("e")).groupBy("e.id").agg(F.min(F.struct("at", "e.turn", "e.name", "e.type")).alias("e"))
    label = F.regexp_replace("e.name", '"', "'")
    nodes = ends.select("e.at", "e.turn", F.concat(F.lit("  "), safe(F.col("id")), F.lit('["'), label, F.lit("<br/>"), "e.type", F.lit('"]')).alias("line"))
    arrow = F.concat(F.lit("  "), safe(F.col("source_id")), F.lit(" -- "), F.col("relation"), F.lit(" --> "), safe(F.col("target_id")))
    lines = nodes.unionByName(rows.select("at", F.lit(2).alias("turn"), arrow.alias("line")))
    return lines.agg(F.concat_ws("\n", F.lit("flowchart LR"), F.transform(F.array_sort(F.collect_list(F.struct("at", "turn", "line"))), lambda x: x["line"])).alias("chart"))


def missing_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id"))).distinct()
    return ends.join(nodes, "id", "left_anti")
