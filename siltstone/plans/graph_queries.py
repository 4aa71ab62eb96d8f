"""Queries of the graph and of the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import exports as X
from ..operators import governance as V
from ..operators import graph as G
from ..operators import ledger as L
from .registry import query
from .retrieval_queries import NOW, now
from .standins import ctes, view
from .text_queries import blocks_sql, likely_sql, norm, polarity_sql, subject_sql, without

VIEW = """v AS (SELECT e.*, s.name AS source_name, s.type AS source_type, s.status AS source_status, t.name AS target_name, t.type AS target_type, t.status AS target_status,
    ev.status AS evidence_status FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id LEFT JOIN evidence ev ON ev.id = e.evidence_id),
    live AS (SELECT * FROM v WHERE status IN ('active', 'provisional') AND source_status IN ('active', 'provisional') AND target_status IN ('active', 'provisional')
    AND (evidence_id IS NULL OR evidence_status IN ('active', 'provisional')))"""
BASE = ctes("edges", "nodes", "evidence") + ", " + VIEW


def _view(t):
    return G.edge_view(view(t, "edges"), view(t, "nodes"), view(t, "evidence"))


def _live(t):
    return G.live_edges(_view(t))


@query("E03_edge_view", f"WITH {BASE} SELECT source_id, source_name, source_type, relation, target_id, target_name, evidence_id, evidence_status, status FROM v")
def edges(t):
    return _view(t).select("source_id", "source_name", "source_type", "relation", "target_id", "target_name", "evidence_id", "evidence_status", "status")


@query("C31_live_edges", f"WITH {BASE} SELECT relation, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM live GROUP BY relation")
def live(t):
    return _live(t).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


@query(
    "E04_hint_nodes",
    f"""WITH {ctes('nodes')}, s AS (SELECT *, CASE WHEN contains(lower(name), 'brand') OR contains(lower(id), 'brand') THEN 8.0 ELSE 0.0 END
        + CASE WHEN contains(lower(name), 'brand') OR contains(lower(id), 'brand') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(summary), 'brand') THEN 0.5 ELSE 0 END
        + CASE WHEN contains(lower(name), 'use') OR contains(lower(id), 'use') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(summary), 'use') THEN 0.5 ELSE 0 END
        + CASE WHEN type IN ('runtime', 'tool', 'concept', 'failure_mode') THEN 0.4 ELSE 0 END AS score FROM nodes
        WHERE status IN ('active', 'provisional') AND (contains(lower(name), 'brand') OR contains(lower(summary), 'brand') OR contains(lower(name), 'use') OR contains(lower(summary), 'use')))
    SELECT id, type, name, round(score, 6) AS score FROM s ORDER BY score DESC, type, name, id LIMIT 50""",
)
def hints(t):
    return G.hint_scores(view(t, "nodes"), "brand", ["brand", "use"], 50).select("id", "type", "name", F.round("score", 6).alias("score"))


@query(
    "E05_search_nodes",
    f"""WITH {ctes('nodes', 'aliases', 'tags')} SELECT DISTINCT n.id, n.type, n.name FROM nodes n LEFT JOIN aliases a ON a.node_id = n.id LEFT JOIN tags g ON g.node_id = n.id
    WHERE n.status IN ('active', 'provisional') AND (contains(lower(n.name), 'build') OR contains(lower(n.summary), 'build') OR contains(lower(a.alias), 'build') OR contains(lower(g.tag), 'build'))
    ORDER BY n.type, n.name, n.id LIMIT 100""",
)
def searched(t):
    return G.search_nodes(view(t, "nodes"), view(t, "aliases"), view(t, "tags"), "build", 100).select("id", "type", "name")


@query(
    "K04_resolve_node",
    f"""WITH {ctes('nodes', 'aliases')}, k AS (SELECT id, type, name, status, name AS key FROM nodes UNION ALL SELECT n.id, n.type, n.name, n.status, a.alias FROM nodes n JOIN aliases a ON a.node_id = n.id),
    r AS (SELECT id, type, name, CASE WHEN id = 'the customer#000000012 inc' OR lower(key) = 'the customer#000000012 inc' THEN 0 WHEN contains(lower(key), 'the customer#000000012 inc') THEN 1 ELSE 2 END AS rank
          FROM k WHERE status IN ('active', 'provisional'))
    SELECT id, type, name, rank FROM r WHERE rank < 2 ORDER BY rank, type, name, id LIMIT 1""",
)
def resolved(t):
    return G.resolve_node(view(t, "nodes"), view(t, "aliases"), "The Customer#000000012 Inc")


@query("K01_incident_edges", f"WITH {BASE} SELECT source_id, relation, target_id, confidence FROM live WHERE (source_id = 'supplier:7' OR target_id = 'supplier:7')")
def incident(t):
    return G.incident(_live(t), "supplier:7").select("source_id", "relation", "target_id", "confidence")


@query("K02_adjacency", f"WITH {BASE}, a AS (SELECT source_id AS a, target_id AS b FROM live UNION ALL SELECT target_id, source_id FROM live) SELECT a, count(*) AS degree, count(DISTINCT b) AS neighbours FROM a GROUP BY a")
def adjacency(t):
    return G.adjacency(_live(t)).groupBy("a").agg(F.count("*").alias("degree"), F.countDistinct("b").alias("neighbours"))


@query(
    "K03_distances",
    f"""WITH RECURSIVE {BASE}, a AS (SELECT source_id AS a, target_id AS b FROM live UNION SELECT target_id, source_id FROM live),
    r(id, depth) AS (SELECT 'region:0', 0 UNION SELECT a.b, r.depth + 1 FROM r JOIN a ON a.a = r.id WHERE r.depth < 3)
    SELECT id, min(depth) AS depth FROM r GROUP BY id""",
)
def distances(t):
    links = G.live_links(view(t, "edges"), view(t, "evidence"))
    return G.distances(G.adjacency(links), "region:0", 3, view(t, "nodes").where(T.is_live(F.col("status")))).select("id", "depth")


@query(
    "K03_shortest_path",
    f"""WITH RECURSIVE {BASE}, a AS (SELECT source_id AS a, target_id AS b FROM live UNION SELECT target_id, source_id FROM live),
    e AS (SELECT max(b) FILTER (b LIKE 'supplier:%') AS origin, max(b) FILTER (b LIKE 'part:%') AS goal FROM a),
    r(id, path) AS (SELECT origin, [origin] FROM e UNION ALL SELECT id, min(path) FROM (SELECT a.b AS id, list_append(r.path, a.b) AS path FROM r JOIN a ON a.a = r.id WHERE len(r.path) <= 4 AND NOT list_contains(r.path, a.b)) GROUP BY id),
    p AS (SELECT path FROM r JOIN e ON r.id = e.goal ORDER BY len(path), path LIMIT 1)
    SELECT goal AS id, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, ' > ') AS path FROM p, e""",
)
def shortest_path(t):
    """The shortest way from the last supplier to the last part in the order of names, the least of equal ones."""
    near = G.adjacency(_live(t)).select("a", "b")
    ends = near.agg(F.max(F.when(F.col("b").startswith("supplier:"), F.col("b"))), F.max(F.when(F.col("b").startswith("part:"), F.col("b")))).first()
    return G.find_path(near, *ends, 4).select("id", "depth", F.array_join("path", " > ").alias("path"))


@query("F01_type_counts", f"WITH {ctes('nodes')} SELECT type, status, count(*) AS n FROM nodes GROUP BY type, status")
def type_counts(t):
    both = G.counts(view(t, "nodes").withColumn("kind", F.concat_ws("|", "type", "status")), "kind")
    return both.select(F.split("kind", r"\|")[0].alias("type"), F.split("kind", r"\|")[1].alias("status"), "n")


@query("F02_table_counts", f"WITH {ctes('nodes', 'edges', 'sources')} SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'embedded', count(*) FROM embeddings")
def table_counts(t):
    return L.table_counts({"nodes": view(t, "nodes"), "edges": view(t, "edges"), "sources": view(t, "sources"), "embedded": t.embeddings})


@query("F03_joined_tags", f"WITH {ctes('tags')} SELECT node_id, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags FROM tags GROUP BY node_id")
def joined_tags(t):
    return G.joined_tags(view(t, "tags"))


_RANKED = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, relation, source_id, target_id"


@query("B07_markdown_edges", f"WITH {BASE} SELECT '- `' || source_id || '` --' || relation || '--> `' || target_id || '` (' || confidence || ')' AS line FROM live ORDER BY {_RANKED} LIMIT 200")
def markdown(t):
    return G.top_edges(_live(t), 200).select(G.markdown_line().alias("line"))


_SAFE = "CASE WHEN regexp_matches({0}, '^[0-9]') THEN 'n_' ELSE '' END || regexp_replace({0}, '[^A-Za-z0-9_]', '_', 'g')"


@query(
    "B08_mermaid",
    f"""WITH {BASE}, x AS (SELECT *, row_number() OVER (ORDER BY relation, source_name, target_name, source_id, target_id) AS pos FROM live QUALIFY pos <= 40),
    e AS (SELECT pos, 0 AS turn, source_id AS id, source_name AS name, source_type AS type FROM x UNION ALL SELECT pos, 1, target_id, target_name, target_type FROM x),
    n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, turn) = 1),
    l AS (SELECT pos, turn, '  ' || {_SAFE.format('id')} || '["' || replace(name, '"', chr(39)) || '<br/>' || type || '"]' AS line FROM n
          UNION ALL SELECT pos, 2, '  ' || {_SAFE.format('source_id')} || ' -- ' || relation || ' --> ' || {_SAFE.format('target_id')} FROM x)
    SELECT 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY pos, turn) AS chart FROM l""",
)
def mermaid(t):
    return G.mermaid(_live(t), 40)


@query("B10_conflict_notes", f"WITH {ctes('conflicts')} SELECT conflict_id, conflict_type, severity FROM conflicts WHERE status IN ('open', 'acknowledged') ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, conflict_id DESC LIMIT 20")
def conflict_notes(t):
    rows = L.listed(view(t, "conflicts"), [L.severity_rank(F.col("severity")), F.desc("conflict_id")], 20, F.col("status").isin(*L.UNRESOLVED))
    return rows.select("conflict_id", "conflict_type", "severity")


@query("B09_top_sources", f"WITH {ctes('sources')} SELECT id, title, credibility_score, '- [' || title || '](' || url || ') (credibility ' || credibility_score || ')' AS line FROM sources WHERE status <> 'deprecated' ORDER BY credibility_score DESC, n DESC, id LIMIT 10")
def top_sources(t):
    return X.top_sources(view(t, "sources"), 10)


@query(
    "B11_export_gates",
    f"""WITH {ctes('conflicts')} SELECT 'open_conflicts' AS gate, count(*) FILTER (status IN ('open', 'acknowledged') AND severity = 'high') AS blocking, count(*) FILTER (status IN ('open', 'acknowledged') AND severity = 'high') = 0 AS passes FROM conflicts
    UNION ALL SELECT 'governance_checks', CASE WHEN count(*) FILTER (text = '') > 0 THEN 1 ELSE 0 END, count(*) FILTER (text = '') = 0 FROM documents""",
)
def gates(t):
    checked = V.checks(("texts", t.documents, F.col("text") == "", F.length("text") < 10))
    return V.export_gates(view(t, "conflicts"), checked)


@query("E19_missing_nodes", f"WITH {ctes('edges', 'nodes')}, k AS (SELECT * FROM nodes WHERE status <> 'deprecated'), e AS (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges) SELECT id FROM e WHERE id NOT IN (SELECT id FROM k)")
def missing(t):
    return G.missing_nodes(view(t, "edges"), view(t, "nodes").where("status != 'deprecated'"))


CLAIMS = f"""kt AS (SELECT *, CASE WHEN type IN {tuple(T.CLAIM_TYPES)} THEN CASE WHEN summary = '' THEN name ELSE summary END
        WHEN regexp_matches(lower(summary), '{T.MODAL.replace("'", "''")}') THEN summary ELSE '' END AS claim_text FROM nodes WHERE status IN ('active', 'provisional')),
    claims AS (SELECT 'claimrec:' || substr(sha1(id || '|' || substr({norm('claim_text')}, 1, 400)), 1, 16) AS claim_id, id AS node_id, claim_text, {subject_sql('claim_text')} AS subject_key,
        {polarity_sql('claim_text')} AS polarity, status FROM kt WHERE claim_text <> '' AND {subject_sql('claim_text')} <> ''),
    classes AS (SELECT subject_key, polarity, {norm('claim_text')} AS said, arg_min(claim_id, node_id) AS claim_id, min(node_id) AS node_id, count(*) AS size FROM claims GROUP BY 1, 2, 3)"""


@query("D14_claim_records", f"WITH {ctes('nodes')}, {CLAIMS} SELECT claim_id, node_id, subject_key, polarity, status FROM claims")
def claims(t):
    return L.claim_records(view(t, "nodes")).select("claim_id", "node_id", "subject_key", "polarity", "status")


@query("E15_contradictions", f"WITH {ctes('nodes')}, {CLAIMS} SELECT p.subject_key, p.claim_id AS pos_claim, n.claim_id AS neg_claim, p.size AS pos_size, n.size AS neg_size FROM classes p JOIN classes n ON p.subject_key = n.subject_key AND p.polarity = 'positive' AND n.polarity = 'negative' AND p.node_id <> n.node_id")
def contradictions(t):
    return L.contradictions(L.claim_records(view(t, "nodes"))).select("subject_key", "pos_claim", "neg_claim", "pos_size", "neg_size")


@query(
    "L08_conflict_ids",
    f"""WITH {ctes('nodes')}, {CLAIMS}, c AS (SELECT p.node_id AS a, n.node_id AS b FROM classes p JOIN classes n ON p.subject_key = n.subject_key AND p.polarity = 'positive' AND n.polarity = 'negative' AND p.node_id <> n.node_id),
    i AS (SELECT *, 'conflict:contradiction:' || substr(sha1(array_to_string(list_sort(['node:' || a || ':positive', 'node:' || b || ':negative']), '|')), 1, 16) AS base FROM c),
    o AS (SELECT base, CASE length(a) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' END AS st FROM i)
    SELECT CASE WHEN st = 'resolved' THEN 'conflict:contradiction:' || substr(sha1(base || '|recurrence|2024-02-10'), 1, 16) ELSE base END AS conflict_id,
        'open' AS status, CASE WHEN st = 'resolved' THEN base END AS previous_conflict_id FROM o""",
)
def conflict_ids(t):
    pairs = L.contradictions(L.claim_records(view(t, "nodes")))
    item = lambda node, role: F.concat(F.lit("node:"), F.col(node), F.lit(f":{role}"))
    found = pairs.select("pos_node", L.conflict_id(F.lit("contradiction"), item("pos_node", "positive"), item("neg_node", "negative")).alias("conflict_id"))
    old = found.withColumn("status", F.when(F.length("pos_node") % 3 == 0, "open").when(F.length("pos_node") % 3 == 1, "resolved")).where("status is not null")
    return L.recorded_conflicts(old.select("conflict_id", "status"), found.select("conflict_id"), "2024-02-10")


@query("E12_duplicate_content", "WITH k AS (SELECT sha256(text) AS key, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT k.key, k.keep_id, d.doc_id AS id FROM documents d JOIN k ON sha256(d.text) = k.key WHERE d.doc_id <> k.keep_id")
def duplicate_content(t):
    return L.duplicate_groups(t.documents, F.sha2("text", 256), "doc_id")


@query(
    "E13_duplicate_sources",
    f"""WITH RECURSIVE {ctes('sources')}, k AS (SELECT id, source_type, {without('title', T.NAME_STOP)} AS key, regexp_replace(lower(split_part(url, '?', 1)), '/+$', '') AS canon FROM sources WHERE status IN ('active', 'stale_pending_refresh')),
    f AS (SELECT canon, min(id) AS keep FROM k GROUP BY canon HAVING count(*) > 1), t AS (SELECT source_type, key, min(id) AS first FROM k WHERE key <> '' GROUP BY 1, 2),
    y AS (SELECT x.source_type, x.key AS l, y.key AS r, x.first AS x, y.first AS y FROM t x JOIN t y ON x.source_type = y.source_type AND x.key <> y.key AND {likely_sql('x.key', 'y.key', 0.92)}),
    {blocks_sql('(SELECT DISTINCT l, r FROM y)')},
    p AS (SELECT keep AS a, k.id AS b, true AS exact_url FROM k JOIN f ON f.canon = k.canon WHERE k.id <> keep
          UNION ALL SELECT t.first, k.id, false FROM k JOIN t USING (source_type, key) WHERE k.id <> t.first
          UNION ALL SELECT least(x, y), greatest(x, y), false FROM y JOIN blocks USING (l, r) WHERE ratio >= 0.92)
    SELECT a, b, bool_or(exact_url) AS exact_url FROM p GROUP BY a, b""",
)
def duplicate_sources(t):
    return L.duplicate_sources(view(t, "sources"))


_ENTITY_LINKS = f"""l AS (SELECT * FROM nodes WHERE status IN ('active', 'provisional')),
    m AS (SELECT id, type, {without('name', T.NAME_STOP)} AS key FROM l),
    k AS (SELECT DISTINCT id, type || '|' || key AS key FROM (SELECT id, type, key FROM m UNION ALL SELECT l.id, l.type, {without('a.alias', T.NAME_STOP)} FROM l JOIN aliases a ON a.node_id = l.id) WHERE key <> ''),
    f AS (SELECT key, min(id) AS keep_id FROM k GROUP BY key HAVING count(*) > 1),
    n AS (SELECT type, key, min(id) AS first, max(id) AS last FROM m WHERE key <> '' GROUP BY type, key),
    y AS (SELECT x.key AS l, y.key AS r, x.first AS x, y.first AS y FROM n x JOIN n y ON x.type = y.type AND x.key <> y.key AND x.first < y.last AND {likely_sql('x.key', 'y.key', 0.9)}),
    {blocks_sql('(SELECT DISTINCT l, r FROM y)')},
    links AS (SELECT DISTINCT keep_id, id FROM k JOIN f USING (key) WHERE id <> keep_id UNION SELECT least(x, y), greatest(x, y) FROM y JOIN blocks USING (l, r) WHERE ratio >= 0.90)"""


@query(
    "E14_duplicate_entities",
    f"""WITH RECURSIVE {ctes('nodes', 'aliases')}, {_ENTITY_LINKS},
    e AS (SELECT keep_id AS a, id AS b FROM links UNION ALL SELECT id, keep_id FROM links),
    c(id, component_id) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(c.component_id) FROM c JOIN e ON e.a = c.id JOIN recurring.c AS o ON o.id = e.b WHERE c.component_id < o.component_id GROUP BY e.b)
    SELECT id, component_id, n_links FROM c JOIN (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a) USING (id)""",
)
def duplicate_entities(t):
    """One row for each linked node: its class over any number of links, and how many links name it."""
    return L.entity_classes(view(t, "nodes"), view(t, "aliases"))


@query(
    "L06_merged_aliases",
    f"""WITH {ctes('nodes', 'aliases')}, l AS (SELECT 'part:' || (p_partkey - p_partkey % 5 + 1) AS keep_id, 'part:' || p_partkey AS id FROM part WHERE p_partkey % 5 > 1),
    a AS (SELECT keep_id, unnest([n.id, n.name]) AS alias FROM l JOIN nodes n USING (id) UNION SELECT keep_id, alias FROM l JOIN aliases ON node_id = id),
    g AS (SELECT x, min(id) AS keep_id FROM (SELECT keep_id AS x, keep_id AS id FROM l UNION SELECT keep_id, id FROM l) GROUP BY x),
    b AS (SELECT x, id FROM (SELECT keep_id AS x, keep_id AS id FROM l UNION SELECT keep_id, id FROM l)),
    h AS (SELECT g.keep_id, b.id FROM b JOIN g USING (x) WHERE b.id <> g.keep_id),
    o AS (SELECT keep_id, unnest([n.id, n.name]) AS alias FROM h JOIN nodes n USING (id) UNION SELECT keep_id, alias FROM h JOIN aliases ON node_id = id)
    SELECT keep_id, string_agg(alias, '; ' ORDER BY alias) AS aliases FROM o GROUP BY keep_id""",
)
def merged(t):
    links = t.part.where("p_partkey % 5 > 1").selectExpr("concat('part:', p_partkey - p_partkey % 5 + 1) AS keep_id", "concat('part:', p_partkey) AS id")
    out = L.merged_aliases(view(t, "nodes"), view(t, "aliases"), links)
    return out.select("keep_id", F.array_join("aliases", "; ").alias("aliases"))


#: Each part is linked with the next one, seven to a chain; every third link is an open conflict of the ledger, others are resolved or of another type.
_CHAIN_SQL = """chain AS (SELECT 'part:' || p_partkey AS keep_id, 'part:' || (p_partkey + 1) AS id, 'dup:' || p_partkey AS conflict_id,
        CASE WHEN p_partkey % 5 = 0 THEN 'contradiction' ELSE 'duplicate_entity' END AS conflict_type, CASE p_partkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS status
        FROM part WHERE p_partkey % 7 <> 0 AND p_partkey < (SELECT max(p_partkey) FROM part)),
    part_of AS (SELECT 'part:' || p_partkey AS id, min('part:' || p_partkey) OVER (PARTITION BY (p_partkey + 6) // 7) AS keep_id, count(*) OVER (PARTITION BY (p_partkey + 6) // 7) AS n FROM part),
    gone AS (SELECT id, keep_id FROM part_of WHERE id <> keep_id AND n > 1),
    taken AS (SELECT keep_id AS node_id, unnest([n.id, n.name]) AS alias FROM gone JOIN nodes n USING (id) UNION SELECT keep_id, alias FROM gone JOIN aliases ON node_id = id),
    fresh AS (SELECT * FROM taken EXCEPT SELECT node_id, alias FROM aliases)"""


def _merged_parts(t):
    last = t.part.agg(F.max("p_partkey").alias("last"))
    p = t.part.crossJoin(F.broadcast(last)).where("p_partkey % 7 <> 0 AND p_partkey < last")  # one row
    chain = p.selectExpr(
        "concat('part:', p_partkey) AS keep_id", "concat('part:', p_partkey + 1) AS id", "concat('dup:', p_partkey) AS conflict_id",
        "CASE WHEN p_partkey % 5 = 0 THEN 'contradiction' ELSE 'duplicate_entity' END AS conflict_type",
        "CASE p_partkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS status",
    )
    state = {k: view(t, k) for k in ("nodes", "aliases", "tags")}
    return state, chain, L.merge_duplicates(state, chain, chain)


@query(
    "L06_merge_changes",
    f"""WITH {ctes('nodes', 'aliases', 'tags')}, {_CHAIN_SQL}
    SELECT 'node' AS object_type, id AS object_id, 'dedupe:merge' AS operation, n.status AS before, 'merged' AS after FROM nodes n JOIN gone USING (id) WHERE n.status <> 'merged'
    UNION ALL SELECT 'alias', node_id, 'dedupe:canonicalize', NULL, alias FROM fresh
    UNION ALL SELECT DISTINCT 'tag', keep_id, 'dedupe:canonicalize', NULL, 'dedupe-canonical' FROM gone""",
)
def merge_changes(t):
    """All that a merge over chains of links changes: statuses of the nodes that go, aliases and tags of those that stay."""
    return _merged_parts(t)[2]["changes"]


@query(
    "L06_merged_nodes",
    f"""WITH {ctes('nodes', 'aliases', 'tags')}, {_CHAIN_SQL}, a AS (SELECT node_id, alias FROM aliases UNION ALL SELECT * FROM fresh),
    g AS (SELECT node_id, tag FROM tags UNION ALL SELECT DISTINCT keep_id, 'dedupe-canonical' FROM gone)
    SELECT n.id, CASE WHEN gone.id IS NULL THEN n.status ELSE 'merged' END AS status, (SELECT string_agg(alias, '; ' ORDER BY alias) FROM a WHERE node_id = n.id) AS aliases,
           (SELECT string_agg(tag, '; ' ORDER BY tag) FROM g WHERE node_id = n.id) AS tags
    FROM nodes n LEFT JOIN gone ON gone.id = n.id""",
)
def merged_nodes(t):
    """Every node after the merge, with its status, aliases and tags."""
    after = _merged_parts(t)[2]
    of = lambda name, c: after[name].groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(c)), "; ").alias(name))
    return after["nodes"].select("id", "status").join(of("aliases", "alias"), "id", "left").join(of("tags", "tag"), "id", "left")


@query(
    "L06_resolved_conflicts",
    f"""WITH {ctes('nodes', 'aliases', 'tags')}, {_CHAIN_SQL}, d AS (SELECT *, conflict_type = 'duplicate_entity' AND status IN ('open', 'acknowledged') AS done FROM chain)
    SELECT conflict_id, CASE WHEN done THEN 'resolved' ELSE status END AS status, CASE WHEN done THEN 'merge_entities' END AS resolution,
           CASE WHEN done THEN (SELECT keep_id FROM part_of WHERE part_of.id = d.id) END AS canonical_id FROM d""",
)
def resolved_conflicts(t):
    return _merged_parts(t)[2]["conflicts"].select("conflict_id", "status", "resolution", "canonical_id")


@query(
    "L07_split_nodes",
    f"""WITH {ctes('nodes', 'aliases', 'tags')}, {_CHAIN_SQL}
    SELECT 'node' AS kind, id AS key, status AS value FROM nodes UNION ALL SELECT 'alias', node_id, alias FROM aliases UNION ALL SELECT 'tag', node_id, tag FROM tags
    UNION ALL SELECT 'conflict', conflict_id, CASE WHEN conflict_type = 'duplicate_entity' AND status = 'acknowledged' THEN 'open' ELSE status END FROM chain""",
)
def split_nodes(t):
    """A merge undone: nodes, aliases and tags are as before, its conflicts are open again."""
    after = _merged_parts(t)[2]
    back = L.split_duplicates(after, after["changes"])
    row = lambda kind, name, key, value: back[name].select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(value).alias("value"))
    rows = row("node", "nodes", "id", "status").unionByName(row("alias", "aliases", "node_id", "alias")).unionByName(row("tag", "tags", "node_id", "tag"))
    return rows.unionByName(row("conflict", "conflicts", "conflict_id", "status"))


_INCOMING = "SELECT 'customer:' || c_custkey AS id, 'account' AS type, upper(c_name) AS name, 'changed' AS summary, 'proposed' AS status, 'high' AS confidence FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'new:' || r_regionkey, 'region', r_name, 'new', 'proposed', 'low' FROM region"


def _incoming(t):
    return t.spark.sql(_INCOMING.replace("FROM customer", "FROM {customer}").replace("FROM region", "FROM {region}"), customer=t.customer, region=t.region)


@query(
    "L01_upsert_nodes",
    f"""WITH {ctes('nodes')}, i AS (SELECT * FROM ({_INCOMING}) UNION ALL SELECT id, type, name, 'also changed', status, confidence FROM ({_INCOMING})),
    p AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY summary DESC) = 1)
    SELECT coalesce(i.id, n.id) AS id, coalesce(i.type, n.type) AS type, coalesce(i.name, n.name) AS name,
    coalesce(i.summary, n.summary) AS summary, coalesce(n.status, i.status) AS status, coalesce(i.confidence, n.confidence) AS confidence FROM nodes n FULL JOIN p i ON i.id = n.id""",
)
def upserted(t):
    twice = _incoming(t).unionByName(_incoming(t).withColumn("summary", F.lit("also changed")))
    return L.upsert(view(t, "nodes"), twice, ["id"], order=[F.col("summary")], keep=["status"])


@query(
    "L01_rewritten_aliases",
    f"""WITH {ctes('aliases')}, i AS ({_INCOMING}) SELECT node_id, alias FROM aliases WHERE node_id NOT IN (SELECT id FROM i) UNION SELECT id, 'also ' || name FROM i WHERE type = 'account'""",
)
def rewritten(t):
    new = _incoming(t).where("type = 'account'").select(F.col("id").alias("node_id"), F.concat(F.lit("also "), "name").alias("alias"))
    state = {k: view(t, k) for k in ("nodes", "aliases", "tags")}
    return L.upsert_nodes(state, {"nodes": _incoming(t), "aliases": new})["aliases"]


@query("L17_insert_missing", f"WITH {ctes('nodes')}, i AS ({_INCOMING}) SELECT * FROM nodes UNION ALL SELECT * FROM i WHERE id NOT IN (SELECT id FROM nodes)")
def inserted(t):
    return L.insert_missing(view(t, "nodes"), _incoming(t), ["id"])


@query(
    "L02_change_items",
    f"""WITH {ctes('nodes')}, i AS ({_INCOMING}) SELECT coalesce(i.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'create' ELSE 'update' END AS action,
    n.name AS before_name, i.name AS after_name FROM i LEFT JOIN nodes n ON i.id = n.id""",
)
def changes(t):
    before, after = view(t, "nodes"), L.upsert(view(t, "nodes"), _incoming(t), ["id"])
    items = L.change_items(before, after, "id", ["name", "summary", "status"])
    return items.select("id", "action", F.get_json_object("before", "$.name").alias("before_name"), F.get_json_object("after", "$.name").alias("after_name"))


@query("L05_rollback", f"WITH {ctes('nodes')}, i AS ({_INCOMING}) SELECT * FROM nodes UNION ALL SELECT id, type, name, summary, 'reverted', confidence FROM i WHERE id NOT IN (SELECT id FROM nodes)")
def rollback(t):
    cols = ["type", "name", "summary", "status", "confidence"]
    before = view(t, "nodes")
    after = L.upsert(before, _incoming(t), ["id"])
    items = L.change_items(before, after, "id", cols)
    return L.rolled_back(after, items, "id", ", ".join(f"{c} string" for c in cols))


@query("L05_rollback_conflicts", f"WITH {ctes('nodes')}, i AS ({_INCOMING}) SELECT id FROM i WHERE id LIKE 'customer:%' AND CAST(substr(id, 10) AS INT) % 8 = 0")
def rollback_conflicts(t):
    cols = ["name", "status"]
    before = view(t, "nodes")
    after = L.upsert(before, _incoming(t), ["id"])
    items = L.change_items(before, after, "id", cols)
    later = after.withColumn("status", F.when(F.col("id").rlike("^customer:") & (F.substring("id", 10, 9).try_cast("int") % 8 == 0), "deprecated").otherwise(F.col("status")))
    return L.rollback_conflicts(later, items, "id", cols).select("id")


@query("L04_set_status", f"WITH {ctes('nodes')} SELECT id, CASE WHEN type = 'account' AND id IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 'deprecated' ELSE status END AS status FROM nodes")
def statuses(t):
    chosen = t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    return L.set_status(view(t, "nodes"), chosen, "id", "deprecated").select("id", "status")


@query("L10_stale_sources", f"WITH {ctes('sources')} SELECT id, last_checked_at IS NULL OR last_checked_at + freshness_window_days * INTERVAL 1 DAY <= {NOW} AS stale FROM sources")
def stale(t):
    return view(t, "sources").select("id", L.is_stale(F.col("last_checked_at"), F.col("freshness_window_days"), now()).alias("stale"))


@query(
    "H04_refresh_candidates",
    f"""WITH {ctes('sources')}, f AS (SELECT * FROM sources WHERE status IN ('active', 'stale_pending_refresh') ORDER BY last_checked_at NULLS FIRST, title, id LIMIT 8)
    SELECT id, title FROM f WHERE last_checked_at IS NULL OR last_checked_at + freshness_window_days * INTERVAL 1 DAY <= {NOW}""",
)
def refresh(t):
    return L.refresh_candidates(view(t, "sources"), now(), 8).select("id", "title")


@query("L16_replace_chunks", "SELECT source, lang, count(*) AS n FROM (SELECT source, lang, doc_id FROM documents WHERE source <> 'src3' UNION ALL SELECT source, 'xx', doc_id FROM documents WHERE source = 'src3' AND doc_id % 40 = 3) GROUP BY source, lang")
def replaced(t):
    cols = t.documents.select("source", "lang", "doc_id")
    new = cols.where("source = 'src3' and doc_id % 40 = 3").withColumn("lang", F.lit("xx"))
    return L.replace_by_key(cols, new, "source").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("I05_pruned_documents", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def pruned(t):
    return L.without_keys(t.documents.select("doc_id"), t.labels, "doc_id")


@query("L20_delete_plan", "WITH k AS (SELECT 'documents' AS name, 'src:evidence:q:' || source || ':' || doc_id AS id FROM documents UNION ALL SELECT 'events', 'src:evidence:q:src' || (user_id % 20) || ':' || event_id FROM events) SELECT name, split_part(id, ':', 4) AS owner, count(*) AS n FROM k GROUP BY ALL")
def delete_plan(t):
    docs = t.documents.select(F.lit("documents").alias("name"), F.concat(F.lit("src:evidence:q:"), "source", F.lit(":"), "doc_id").alias("id"))
    events = t.events.select(F.lit("events").alias("name"), F.concat(F.lit("src:evidence:q:src"), F.col("user_id") % 20, F.lit(":"), "event_id").alias("id"))
    return docs.unionByName(events).groupBy("name", L.owner_of(F.col("id")).alias("owner")).agg(F.count("*").alias("n"))


@query("F16_open_conflicts", f"WITH {ctes('conflicts')} SELECT conflict_type, count(*) FILTER (status IN ('open', 'acknowledged')) AS n_open, count(*) AS n FROM conflicts GROUP BY conflict_type")
def open_conflicts(t):
    return view(t, "conflicts").groupBy("conflict_type").agg(F.count_if(F.col("status").isin(*L.UNRESOLVED)).alias("n_open"), F.count("*").alias("n"))
