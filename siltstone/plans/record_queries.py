"""Queries of sinks, records and the remaining mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bundles as B
from ..operators import chunking as C
from ..operators import entities as E
from ..operators import evidence as V
from ..operators import exports as X2
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import retrieval as R
from ..operators import runs as U
from ..operators import vectors as VEC
from ..sources import connectors as K
from ..sources import converters as X
from ..sources import media as M
from .evidence_queries import _EM, _accepted, _CANDS, _cands
from .registry import query
from .retrieval_queries import _ITEMS, _items, bm25_sql
from .standins import ctes, view
from .text_queries import strip


@query("A04_text_units", f"SELECT conv_id, turn, {strip('text')} AS text, length({strip('text')}) AS n_chars FROM conversations")
def text_units(t):
    text = T.strip(F.decode(F.encode("text", "utf-8"), "utf-8"))
    return t.conversations.select("conv_id", "turn", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


@query("A06_html_table_rows")
def table_rows(t):
    """The supplied pages hold no tables, so each page gets one made of its own address; rows come out labelled."""
    made = F.concat(F.lit("<table><caption>Pages</caption><tr><th>id</th><th>address</th></tr><tr><td>"), F.col("page_id"), F.lit("</td><td>"), F.col("url"), F.lit("</td></tr></table>"), F.col("html"))
    files = t.pages.select(F.col("page_id").cast("string").alias("path"), F.encode(made, "utf-8").alias("content"), F.lit("text/html").alias("media_type"))
    return X.convert(files).where("unit_type = 'table_row'").select(F.col("source_ref").cast("long").alias("page_id"), "text")


@query(
    "A16_sidecars",
    """WITH f AS (SELECT '/m/p' || p_partkey || '.mp4' AS path, p_partkey AS k FROM part) SELECT path, replace(path, '.mp4', CASE WHEN k % 4 = 0 THEN '.transcript.srt' WHEN k % 6 = 0 THEN '.vtt' ELSE '.txt' END) AS sidecar
       FROM f WHERE k % 4 = 0 OR k % 6 = 0 OR k % 10 = 0""",
)
def sidecars(t):
    name = lambda suffix: F.concat(F.lit("/m/p"), "p_partkey", F.lit(suffix)).alias("path")
    some = lambda n, suffix: t.part.where(F.col("p_partkey") % n == 0).select(name(suffix))
    return M.sidecar(t.part.select(name(".mp4")), some(4, ".transcript.srt").unionByName(some(6, ".vtt")).unionByName(some(10, ".txt")))


@query("A32_warehouse_rollup", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def warehouse(t):
    t.events.createOrReplaceTempView("warehouse_events")
    house = K.Warehouse(t.spark, ("warehouse_events",), max_bytes=1 << 50)
    return house.rollup("warehouse_events", lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")))


@query("A33_mock_metrics", "SELECT r_name AS client_id, 40 + 8 * length(r_name) AS leads, 4 + length(r_name) % 7 AS opportunities, 1000.0::DOUBLE * length(r_name) AS pipeline_amount FROM region")
def mock(t):
    """The mock system's numbers for the regions' names; their five names are configuration."""
    return K.MockSystem(t.spark, [r[0] for r in t.region.select("r_name").collect()]).metrics({})


@query(
    "B12_retrieval_log",
    f"""WITH {bm25_sql(12, _ITEMS)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)
    SELECT i.query_id, i.text, 'keyword' AS mode, count(doc_id) AS n_results, coalesce(string_agg(doc_id || ':' || rank, ',' ORDER BY rank) FILTER (rank <= 10), '') AS logged FROM ({_ITEMS}) i LEFT JOIN r USING (query_id) GROUP BY 1, 2""",
)
def retrieval_log(t):
    log = R.retrieval_log(R.bm25(t.documents, _items(t), "doc_id", "text"), _items(t), "keyword")
    best = F.transform(F.from_json("payload", "array<struct<rank:int, doc_id:long, score:double>>"), lambda h: F.concat_ws(":", h["doc_id"], h["rank"]))
    return log.select("query_id", "text", "mode", "n_results", F.array_join(best, ",").alias("logged"))


@query("D02_legacy_chunks")
def legacy(t):
    """Paragraph chunks whose tails begin the next chunk; the carried tail has no equal in SQL."""
    return C.chunk_rows(t.documents.select("doc_id", "text", F.lit("legacy").alias("strategy"))).select("doc_id", "chunk_index", "text_hash", "token_estimate")


@query("D05_code_chunks")
def code_chunks(t):
    return C.chunk_rows(t.pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("code").alias("strategy"))).select("doc_id", "chunk_index", "text_hash")


@query(
    "D06_json_values",
    """SELECT event_id, json_keys(props)[1] AS key, '{' || chr(10) || '  "' || json_keys(props)[1] || '": ' || json_extract(props, '$.' || json_keys(props)[1]) || chr(10) || '}' AS text FROM events""",
)
def json_blocks(t):
    """A block for each top-level key, each a chunk of its own at a target that holds no two."""
    rows = C.chunk_rows(t.events.select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"), F.lit("json").alias("strategy")), target=24, overlap=0)
    return rows.select(F.col("doc_id").alias("event_id"), F.col("section").alias("key"), "text")


@query(
    "D09_document_records",
    f"""SELECT doc_id, 'doc:' || source || ':' || substr(sha256({strip('text')}), 1, 10) AS id, sha256({strip('text')}) AS content_hash FROM documents""",
)
def records(t):
    digest = F.sha2(T.normalize_structured(F.col("text")), 256)
    return t.documents.select("doc_id", F.concat_ws(":", F.lit("doc"), T.slug(F.col("source")), F.substring(digest, 1, 10)).alias("id"), digest.alias("content_hash"))


@query("E07_accepted_mentions", f"WITH {_EM} SELECT em.node_id, s_name AS name, em.chunk_id, o_orderpriority AS title FROM em JOIN supplier ON node_id = 'supplier:' || s_suppkey JOIN orders ON o_orderkey = chunk_id WHERE confidence >= 0.05")
def mentions(t):
    s = t.supplier.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    o = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("title"))
    return _accepted(t).where("confidence >= 0.05").join(s, "node_id").join(o, "chunk_id").select("node_id", "name", "chunk_id", "title")


@query("E11_source_lookup", f"WITH {ctes('chunks', 'sources')} SELECT c.chunk_id, s.title AS source_title, s.credibility_score FROM chunks c LEFT JOIN sources s ON s.id = c.source_id AND s.status = 'active'")
def source_lookup(t):
    rows = R.source_of(view(t, "chunks"), view(t, "sources").where("status = 'active'"))
    return rows.select("chunk_id", "source_title", F.col("source_credibility").alias("credibility_score"))


@query("F17_tenant_counts", "SELECT source AS client_id, 'documents' AS name, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'src' || (conv_id % 20), 'turns', count(*) FROM conversations GROUP BY 1")
def tenants(t):
    return L.table_counts({"documents": t.documents, "turns": t.conversations}, {"documents": F.col("source"), "turns": F.concat(F.lit("src"), F.col("conv_id") % 20)})


@query("H06_hit_listing", "SELECT p_partkey, p_retailprice FROM part WHERE p_size > 10 AND p_brand = 'Brand#1' OR p_size > 10 AND p_brand LIKE 'Brand#2%' ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def hit_listing(t):
    open_ = (F.col("p_size") > 10) & ((F.col("p_brand") == "Brand#1") | F.col("p_brand").startswith("Brand#2"))
    return L.listed(t.part, [F.desc("p_retailprice"), F.col("p_partkey")], 30, open_).select("p_partkey", "p_retailprice")


@query(
    "J09_entity_search",
    f"""WITH {_EM}, g AS (SELECT node_id, normalized, count(*) AS n, max(annotation) AS annotation, arg_max(confidence, annotation) AS confidence FROM em GROUP BY 1, 2), h AS (SELECT node_id, n, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, confidence DESC, normalized) AS rn FROM g),
    t AS (SELECT node_id FROM (SELECT * FROM h WHERE rn = 1) ORDER BY n DESC, node_id LIMIT 10),
    c AS (SELECT node_id, chunk_id, count(*) AS n, max(confidence) AS confidence FROM em WHERE node_id IN (SELECT node_id FROM t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC, n DESC, chunk_id) AS rank FROM c)
    SELECT node_id, chunk_id, rank FROM r WHERE rank <= 5""",
)
def entity_search(t):
    m = _accepted(t)
    hints = E.mention_hints(m, 10).select("node_id")
    return E.top_chunks_per_entity(m.join(hints, "node_id", "left_semi"), 5).select("node_id", "chunk_id", "rank")


@query("L18_annotation_ids", "SELECT conv_id, 'annotation:' || substr(sha1('mention|' || string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) || '|' || string_agg(DISTINCT role, ',' ORDER BY role)), 1, 16) AS id FROM conversations GROUP BY conv_id")
def annotation_ids(t):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("chunks"), F.array_sort(F.collect_set("role")).alias("entities"))
    key = [F.lit("mention"), F.array_join(F.transform("chunks", lambda c: c.cast("string")), ","), F.array_join("entities", ",")]
    return g.select("conv_id", T.stable_id("annotation", *key).alias("id"))


@query(
    "L19_relation_upsert",
    f"""WITH c AS ({_CANDS}), o AS (SELECT subject, predicate, object, 'accepted' AS status, max(confidence) AS confidence FROM c WHERE candidate_id % 2 = 0 GROUP BY 1, 2, 3), n AS (SELECT subject, predicate, object, 'candidate' AS status, max(confidence) AS confidence FROM c GROUP BY 1, 2, 3)
    SELECT n.subject, n.predicate, n.object, coalesce(o.status, n.status) AS status, CAST(n.confidence AS DOUBLE) AS confidence FROM n LEFT JOIN o USING (subject, predicate, object)""",
)
def relation_upsert(t):
    best = lambda df, s: df.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence")).withColumn("status", F.lit(s))
    old, new = best(_cands(t).where("candidate_id % 2 = 0"), "accepted"), best(_cands(t), "candidate")
    return L.upsert(old, new, ["subject", "predicate", "object"], keep=["status"])


@query("L23_cascade_delete", "SELECT 'documents' AS name, count(*) AS n FROM documents WHERE source <> 'src4' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src4') UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src4')")
def cascade(t):
    ids = t.documents.withColumn("source_id", F.concat(F.lit("src:evidence:q:"), "source", F.lit(":h")))
    gone = ids.where(L.owner_of(F.col("source_id")) == "src4").select("doc_id")
    left = lambda df, key: L.without_keys(df.withColumnRenamed(key, "doc_id"), gone, "doc_id").agg(F.count("*").alias("n"))
    out = left(t.documents, "doc_id").select(F.lit("documents").alias("name"), "n")
    for name, df, key in (("labels", t.labels, "doc_id"), ("embeddings", t.embeddings, "vec_id")):
        out = out.unionByName(left(df, key).select(F.lit(name).alias("name"), "n"))
    return out


@query("L13_review_resolution", f"WITH {ctes('conflicts')} SELECT conflict_id, CASE WHEN status = 'open' AND conflict_id % 2 = 0 THEN 'resolved' ELSE status END AS status FROM conflicts")
def review(t):
    k = view(t, "conflicts")
    chosen = k.where("status = 'open' and conflict_id % 2 = 0")
    return L.set_status(k, chosen, "conflict_id", "resolved").select("conflict_id", "status")


@query(
    "L13_review_decisions",
    """WITH d AS (SELECT o_orderkey AS review_id, o_orderkey * 10 AS candidate_id, 'open' AS before, CASE WHEN o_orderkey % 2 = 0 THEN 'resolved' ELSE 'dismissed' END AS after,
        CASE WHEN o_orderkey % 2 = 0 THEN 'accept' ELSE '' END AS resolution FROM orders WHERE o_orderkey % 3 = 0)
    SELECT o.o_orderkey AS review_id, coalesce(d.after, 'open') AS status, CASE WHEN d.resolution = 'accept' THEN 'by=x;resolution=accept' ELSE 'by=x' END AS notes, d.after AS decided FROM orders o LEFT JOIN d ON d.review_id = o.o_orderkey""",
)
def review_decisions(t):
    """Review items after the decisions on every third of them, with the decision that each has in the log."""
    items = t.orders.select(F.col("o_orderkey").alias("review_id"), (F.col("o_orderkey") * 10).alias("candidate_id"), F.lit("open").alias("status"), F.create_map(F.lit("by"), F.lit("x")).alias("notes"))
    even = F.col("review_id") % 2 == 0
    decided = items.where("review_id % 3 = 0").select("review_id", F.when(even, "resolved").otherwise("dismissed").alias("status"), F.when(even, "accept").otherwise("").alias("resolution"), F.lit("").alias("notes"))
    after, log = U.resolve_reviews(items, decided, "2024-02-10")
    notes = F.array_join(F.array_sort(F.transform(F.map_entries("notes"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return after.select("review_id", "status", notes.alias("notes")).join(log.select("review_id", F.col("after").alias("decided")), "review_id", "left")


@query("L14_archived_clients", "SELECT source AS client_id, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY 1")
def archived(t):
    clients = t.documents.select(F.col("source").alias("client_id")).distinct().withColumn("status", F.lit("active"))
    marked = L.set_status(clients, clients.where("client_id in ('src1', 'src2')"), "client_id", "archived")
    live = marked.where("status != 'archived'").select(F.col("client_id").alias("source"))
    return t.documents.join(live, "source", "left_semi").groupBy(F.col("source").alias("client_id")).agg(F.count("*").alias("n"))


@query("M05_bundle_rows", "SELECT r_name AS bundle_id, n_name AS anchor_id, sha256(r_name || '|' || n_name) AS row_hash FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 UNION ALL SELECT r_name, 'replaced', sha256(r_name || '|replaced') FROM region WHERE r_regionkey = 2")
def bundle(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("bundle_id"), F.col("n_name").alias("anchor_id"))
    new = t.region.where("r_regionkey = 2").select(F.col("r_name").alias("bundle_id"), F.lit("replaced").alias("anchor_id"))
    return L.replace_by_key(rows, new, "bundle_id").withColumn("row_hash", F.sha2(F.concat_ws("|", "bundle_id", "anchor_id"), 256))


@query(
    "M05_changed_rows",
    """SELECT 'p' || p_partkey AS key, CASE WHEN p_partkey % 40 = 7 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_partkey % 40 IN (7, 9)
    UNION ALL SELECT 'new' || r_regionkey, 'added' FROM region""",
)
def changed_bundle_rows(t):
    """What differs between two states of a bundle of anchors, found from the roots of their digest trees."""
    rows = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("anchor_id"), F.col("p_brand").alias("authoritative_source"), F.col("p_size").alias("freshness_sla_hours"), "p_partkey")
    later = rows.where("p_partkey % 40 != 7").withColumn("freshness_sla_hours", F.when(F.col("p_partkey") % 40 == 9, F.col("freshness_sla_hours") + 1).otherwise(F.col("freshness_sla_hours")))
    more = t.region.select(F.concat(F.lit("new"), "r_regionkey").alias("anchor_id"), F.col("r_name").alias("authoritative_source"), F.lit(24).alias("freshness_sla_hours"))
    old, new = rows.drop("p_partkey"), later.drop("p_partkey").unionByName(more)
    digits = B.leaf_digits(t.part.count())
    trees = [B.digest_tree(df, "anchor_id", digits) for df in (old, new)]
    return B.changed_rows(old, new, "anchor_id", *trees, digits)


@query("N04_card_listing", "SELECT client_id, query_id, evidence_id FROM (SELECT user_id AS client_id, event_type AS query_id, event_id AS evidence_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND query_id <> 'view'")
def card_listing(t):
    cards = t.events.where("event_type != 'view'").select(F.col("user_id").alias("client_id"), F.col("event_type").alias("query_id"), F.col("event_id").alias("evidence_id"), F.col("ts").alias("fresh_at"))
    return V.latest(cards, ["client_id", "query_id"]).select("client_id", "query_id", "evidence_id")


@query("N12_capture_ids", "SELECT DISTINCT 'src:reach-evidence:' || event_type || ':u' || user_id || ':' || substr(sha256(event_type || '|u' || user_id), 1, 8) AS source_id FROM events")
def capture_ids(t):
    return t.events.select(X2.capture_source_id(F.col("event_type"), F.concat(F.lit("u"), "user_id")).alias("source_id")).distinct()


_NODE_HITS = f"""q AS (SELECT query_id, lower(text) AS q, regexp_extract_all(lower(text), '{T.TOKEN}')[1:8] AS tokens FROM (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT 1000 + r_regionkey, lower(r_name) FROM region)),
    h AS (SELECT query_id, id, name, type, CASE WHEN contains(lower(name), q) OR contains(lower(id), q) THEN 8.0 ELSE 0.0 END + 2.0 * len(list_filter(tokens, lambda w: contains(lower(name), w) OR contains(lower(id), w)))
          + 0.5 * len(list_filter(tokens, lambda w: contains(lower(summary), w))) + CASE WHEN type IN ('runtime', 'tool', 'concept', 'failure_mode') THEN 0.4 ELSE 0.0 END AS score
          FROM nodes, q WHERE status IN ('active', 'provisional') AND (contains(lower(name), q) OR contains(lower(summary), q) OR len(list_filter(tokens, lambda w: contains(lower(name), w) OR contains(lower(summary), w))) > 0))"""


@query(
    "J03_node_hints",
    f"""WITH {ctes('nodes')}, {_NODE_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, type, name, id) AS rank FROM h)
    SELECT query_id, id AS node_id, round(score, 6) AS score, rank FROM r WHERE rank <= 8""",
)
def node_hints(t):
    """Graph hints for every benchmark passage and for every region's name."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    q = q.unionByName(t.region.select((F.lit(1000) + F.col("r_regionkey")).alias("query_id"), F.lower("r_name").alias("text")))
    return G.node_hints(view(t, "nodes"), q).select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@query(
    "D20_embed_job",
    f"""SELECT doc_id, CASE WHEN vec_id IS NOT NULL THEN 64 ELSE 384 END AS dims, vec_id IS NOT NULL OR length(text) >= 4 OR regexp_matches(lower(text), '{T.TOKEN}') AS has_values FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
)
def embed_job(t):
    """Documents without a vector get one by the local model; those that have one keep it."""
    have = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding").join(t.documents.select("doc_id"), "doc_id", "left_semi")
    new = VEC.embed(VEC.pending(t.documents, have, "doc_id"), "doc_id", "text").select("doc_id", "embedding")
    rows = L.insert_missing(have, new, ["doc_id"])
    return rows.select("doc_id", F.size("embedding").alias("dims"), F.exists("embedding", lambda x: x != 0).alias("has_values"))
