"""Queries of connectors, contracts, exports, streams' batch forms and the remaining table operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import evidence as V
from ..operators import exports as X
from ..operators import governance as W
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import retrieval as R
from ..sources import archive as A
from ..sources import connectors as K
from ..sources import readers, sinks
from ..sources import reports as P
from ..shared import scratch
from ..streaming import incremental as S
from . import manifests as N
from .evidence_queries import _MET, _metrics
from .registry import query
from .standins import ctes, view


def _clients(t):
    return [N.Client(f"c{i}", {"crm": ["tables"], "ads": ["lines"], "analytics": ["events"]}, status="archived" if i == 7 else "active") for i in range(25)]


def _connectors(t):
    client = lambda c: F.concat(F.lit("c"), c)
    contacts = t.customer.select(client(F.col("c_nationkey")).alias("client_id"), F.lit("subscriber").alias("stage"))
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    deals = j.select(
        client(F.col("c_nationkey")).alias("client_id"), F.col("o_totalprice").cast("string").alias("amount"),
        F.when(F.col("o_orderstatus") == "O", "closedwon").otherwise("open").alias("stage"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("closed_at"),
    )
    s = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    ads = s.select(
        client(F.col("s_nationkey")).alias("client_id"), F.col("l_shipdate").alias("day"), (F.col("l_quantity") * 1e6).cast("long").alias("cost_micros"),
        F.lit(10).cast("long").alias("impressions"), F.lit(2).cast("long").alias("clicks"), F.lit(1.0).alias("conversions"), F.lit(2.0).alias("conversions_value"),
    )
    web = t.events.select(
        client(F.col("user_id") % 25).alias("client_id"), F.col("ts").alias("day"), F.lit(1).cast("long").alias("sessions"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long").alias("key_events"), F.lit(0.5).alias("engagement_rate"),
    )
    return {"tables": K.CrmTables(contacts, deals), "lines": K.AdsTable(ads), "events": K.AnalyticsTable(web)}


_RUN = """k AS (SELECT 'c' || c_nationkey AS client_id, count(*) AS leads FROM customer GROUP BY 1),
    d AS (SELECT 'c' || c_nationkey AS client_id, count(*) AS opportunities, round(sum(o_totalprice), 2) AS pipeline_amount, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS closed_won_revenue
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2100-01-01' GROUP BY 1),
    m AS (SELECT client_id, 'leads' AS metric, leads::DOUBLE AS value FROM k UNION ALL SELECT k.client_id, unnest(['opportunities', 'pipeline_amount', 'closed_won_revenue']),
        unnest([coalesce(opportunities, 0)::DOUBLE, coalesce(pipeline_amount, 0), coalesce(closed_won_revenue, 0)]) FROM k LEFT JOIN d USING (client_id))"""
_DATES = {"start_date": "1995-01-01", "end_date": "2100-01-01"}


@query("N08_multi_client_run", f"WITH {_RUN} SELECT client_id, 'crm' AS kind, 'tables' AS provider, metric, value FROM m WHERE client_id <> 'c7'")
def multi_client(t):
    rows, failed = N.run(N.BUILTIN["pipeline_health"], _clients(t), _connectors(t), _DATES)
    return rows


@query("N03_evidence_cards")
def cards(t):
    """Evidence cards of a contract over three systems; their ids hash JSON, which engines write differently."""
    rows, _ = N.run(N.BUILTIN["full_gtm_signal_check"], _clients(t), _connectors(t), _DATES)
    c = N.evidence_cards(N.BUILTIN["full_gtm_signal_check"], rows, "2024-02-10 12:00:00")
    return c.select("evidence_id", "client_id", "query_id", F.size("metrics").alias("n_metrics"), F.array_join("conflicts", ",").alias("conflicts"), "quality", "score")


@query("B05_evidence_documents")
def documents(t):
    rows, _ = N.run(N.BUILTIN["pipeline_health"], _clients(t), _connectors(t), _DATES)
    return X.evidence_source(N.evidence_cards(N.BUILTIN["pipeline_health"], rows, "2024-02-10 12:00:00"))


@query(
    "B06_context_pack",
    rf"""WITH m AS ({_MET}), c AS (SELECT client_id, string_agg('- ' || metric || ': ' || value || ' (source: ' || provider || ')', chr(10) ORDER BY metric, value, provider) AS lines FROM m GROUP BY 1)
    SELECT 'ev:' || client_id AS evidence_id, '# Pipeline Health Check' || chr(10) || chr(10) || '- client: `' || client_id || '`' || chr(10) || '- evidence: `ev:' || client_id || '`' || chr(10) || chr(10) || '## Pipeline Readout' || chr(10) || chr(10)
        || 'Quality: ok' || chr(10) || chr(10) || '## Metrics' || chr(10) || chr(10) || lines || chr(10) || chr(10) || '## Guidance' || chr(10) || chr(10) || '- {X.GUIDANCE["pipeline_health_check"][2][0]}' || chr(10) || '- {X.GUIDANCE["pipeline_health_check"][2][1]}'
        || chr(10) || '- {X.GUIDANCE["pipeline_health_check"][2][2]}' || chr(10) || chr(10) || '## Conflicts' || chr(10) || chr(10) || '- No conflicts recorded.' AS pack FROM c""",
)
def packs(t):
    c = _metrics(t).groupBy("client_id").agg(F.collect_list(F.struct("metric", "value", "provider")).alias("metrics"))
    c = c.withColumns({"evidence_id": F.concat(F.lit("ev:"), "client_id"), "quality": F.lit("ok"), "conflicts": F.array().cast("array<string>")})
    return X.context_pack(c, "pipeline_health_check")


@query("B13_redaction", "SELECT c_custkey, '[REDACTED]' AS api_token, 'ENV_' || c_custkey AS secret_env, c_name AS name FROM customer")
def redaction(t):
    config = F.create_map(F.lit("Api_Token"), F.col("c_name"), F.lit("secret_ENV"), F.concat(F.lit("ENV_"), "c_custkey"), F.lit("name"), F.col("c_name"))
    m = t.customer.select("c_custkey", X.redacted(config).alias("m"))
    return m.select("c_custkey", F.col("m")["Api_Token"].alias("api_token"), F.col("m")["secret_ENV"].alias("secret_env"), F.col("m")["name"].alias("name"))


def _event_reports(t):
    """The events as a system that gives them by day, in the order of their ids."""
    path = f"{t.sf_dir}/events.parquet"

    def fetch(day, columns, limit):
        import datetime

        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        at = datetime.datetime.combine(day, datetime.time())
        held = (pc.field("ts") >= at) & (pc.field("ts") < at + datetime.timedelta(1))
        rows = ds.dataset(path, format="parquet").to_table(columns=["event_id", *columns], filter=held).sort_by("event_id")
        return list(zip(*(rows[c].slice(0, limit).to_pylist() for c in columns))), rows.num_rows

    return P.report_source("event_reports", fetch, {"event_type": "string", "value": "double", "user_id": "long"})


@query(
    "A31_report_days",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM events WHERE ts >= '2024-01-03' AND ts < '2024-01-21')
    SELECT day, round(sum(value), 4) AS value, 1 AS n_days, count(*) AS n_rows, max(n) AS n_reported, max(n) > 300 AS partial_data FROM d WHERE rn <= 300 GROUP BY day""",
)
def report_days(t):
    """Daily reports of at most 300 rows over a window of days: what each sums to, and whether the report was cut."""
    rows = P.read_reports(t.spark, _event_reports(t), ["value"], "2024-01-03", "2024-01-20", 300)
    found = P.completeness(rows, ["day"], [F.round(F.sum("value"), 4).alias("value")])
    return found.select("day", "value", F.col("n_days").cast("int").alias("n_days"), "n_rows", "n_reported", "partial_data")


@query(
    "B13_client_archive",
    """WITH m AS (SELECT source AS client_id, 'documents/' || doc_id || '.txt' AS path, coalesce(text, '') AS body FROM documents
        UNION ALL SELECT 'src' || (c_custkey % 20), 'settings/' || c_custkey || '.json', '{' || chr(10) || '  "api_token": "[REDACTED]",' || chr(10) || '  "name": "' || c_name || '",' || chr(10) || '  "token_env": "ENV_' || c_custkey || '"' || chr(10) || '}' || chr(10) FROM customer)
    SELECT client_id, path, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256 FROM m WHERE client_id IS NOT NULL""",
)
def client_archive(t):
    """Documents and settings of every client, written to its archive and read back by ranges."""
    settings = F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("t-1").alias("api_token"), F.concat(F.lit("ENV_"), "c_custkey").alias("token_env")))
    members = t.documents.select(F.col("source").alias("client_id"), F.concat(F.lit("documents/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("body")).unionByName(
        t.customer.select(F.concat(F.lit("src"), F.col("c_custkey") % 20).alias("client_id"), F.concat(F.lit("settings/"), "c_custkey", F.lit(".json")).alias("path"), settings.cast("binary").alias("body"))
    )
    out = scratch(t.spark, "archives")
    found = A.read_members(A.export_clients(members, out, "2024-02-10T12:00:00+00:00"), out)
    return found.select("client_id", "path", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha256"))


@query(
    "C33_capture_url",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'https://arxiv.org/abs/' || p_size WHEN 1 THEN 'https://arxiv.org/abs/x' || p_partkey WHEN 2 THEN 'https://pdf/' || p_partkey WHEN 3 THEN 'https://u/' || p_partkey
       WHEN 4 THEN 'https://doi.org/10.' || p_partkey WHEN 5 THEN 'https://www.semanticscholar.org/paper/' || p_partkey ELSE 'http://c/' || p_partkey END AS url FROM part""",
)
def capture_urls(t):
    k, n = F.col("p_partkey") % 7, F.col("p_partkey").cast("string")
    url = F.when(k == 3, F.concat(F.lit("https://u/"), n)).when(k.isin(4, 5, 6), F.lit("https://semanticscholar.org/x")).otherwise("")
    canonical = F.when(k == 1, F.concat(F.lit("arxiv:x"), n)).when(k == 5, F.concat(F.lit("s2:"), n)).when(k == 6, F.concat(F.lit("http://c/"), n)).otherwise("")
    arxiv, doi = F.when(k == 0, F.col("p_size").cast("string")), F.when(k == 4, F.concat(F.lit("10."), n))
    return t.part.select("p_partkey", X.capture_url(url, canonical, arxiv, doi, F.when(k == 2, F.concat(F.lit("https://pdf/"), n))).alias("url"))


@query("C27_conversion_names", "SELECT event_type, trim(replace(upper(event_type), '_', ' ')) <> '' AS named, lower(trim(replace(event_type, '_', ' '))) AS name, count(*) AS n FROM events GROUP BY event_type")
def conversion_names(t):
    name = T.conversion_name(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", (name != "").alias("named"), name.alias("name"), "n")


@query("A07_row_text", "SELECT c_custkey, 'c_name: ' || c_name || '; c_mktsegment: ' || c_mktsegment AS row_text FROM customer")
def row_texts(t):
    return t.customer.select("c_custkey", readers.row_text(["c_name", "c_mktsegment"]).alias("row_text"))


@query("A08_json_values", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_values(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("A22_corpus_manifest", "SELECT DISTINCT 'root/' || source || '/' || CASE doc_id % 3 WHEN 0 THEN 'a.md' WHEN 1 THEN 'b/c.txt' ELSE 'x.bin' END AS path FROM documents WHERE source <> 'src3' AND doc_id % 3 < 2 AND length(text) <= 5000")
def corpus_manifest(t):
    name = F.element_at(F.array(*map(F.lit, ["a.md", "b/c.txt", "x.bin"])), (F.col("doc_id") % 3 + 1).cast("int"))
    files = t.documents.select(F.concat_ws("/", F.lit("root"), "source", name).alias("path"), F.length("text").alias("length"))
    return readers.within_manifest(files, ["root/**"], ["src3/**"], [".md", ".txt", ".bin"][:2], 5000).select("path")


@query("A30_ads_window", "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1")
def ads_window(t):
    rows = K._day(t.lineitem, "l_shipdate", {"start_date": "1995-01-01", "end_date": "1996-12-31"})
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    "A36_graph_nodes",
    """SELECT 'concept:' || r_regionkey AS id, 'concept' AS type, r_name AS name, 'active' AS status FROM region UNION ALL SELECT 'source:' || n_nationkey, 'source', n_name, 'active' FROM nation
    UNION ALL SELECT 'claim:' || s_suppkey, 'claim', s_name, 'active' FROM supplier""",
)
def graph_nodes(t):
    tables = {"concept": (t.region, "r_regionkey", "r_name", "r_name"), "source": (t.nation, "n_nationkey", "n_name", "n_name"), "claim": (t.supplier, "s_suppkey", "s_name", "s_name")}
    return G.library_nodes(tables).select("id", "type", "name", "status")


@query(
    "A36_graph_edges",
    """SELECT 'source:' || n_nationkey AS source_id, 'documents' AS relation, 'concept:' || n_regionkey AS target_id FROM nation
    UNION SELECT 'source:' || s_nationkey, 'supports', 'claim:' || s_suppkey FROM supplier""",
)
def graph_edges(t):
    documents = (t.nation, "source", "n_nationkey", "documents", "concept", "n_regionkey")
    return G.library_edges([documents, (t.supplier, "source", "s_nationkey", "supports", "claim", "s_suppkey")])


@query("B01_captures", r"SELECT 'src:' || source AS source_id, count(*) AS n FROM (SELECT DISTINCT source, sha256(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) FROM documents) GROUP BY 1")
def capture_sink(t):
    """Captures of every document, written in two runs of which the second holds the first; a text is one version of its source."""
    root = scratch(t.spark, "captures")
    rows = t.documents.select(
        F.concat(F.lit("src:"), "source").alias("source_id"), F.lit("").alias("url"), F.lit(None).cast("string").alias("title"), "text", F.lit("2024-02-10").cast("timestamp").alias("captured_at")
    )
    sinks.capture(rows.where("source < 'src5'"), root)
    sinks.capture(rows, root)
    return t.spark.read.parquet(f"{root}/captures").groupBy("source_id").agg(F.count("*").alias("n"))


@query("C35_canonical_json", """SELECT event_id, '{"a":"' || event_type || '","b":"' || user_id || '"}' AS json, sha256('{"a":"' || event_type || '","b":"' || user_id || '"}') AS hash FROM events""")
def canonical(t):
    values = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return t.events.select("event_id", W.canonical_json(values).alias("json"), W.canonical_hash(values).alias("hash"))


@query(
    "M03_ledger_append",
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type, 'u' || user_id AS actor, sha256(CAST(event_id AS VARCHAR)) AS payload_hash FROM events),
    r AS (SELECT user_id, seq, sha256(event_type || '|' || actor || '|' || payload_hash || '|') AS receipt_hash FROM e WHERE seq = 1
          UNION ALL SELECT e.user_id, e.seq, sha256(e.event_type || '|' || e.actor || '|' || e.payload_hash || '|' || r.receipt_hash) FROM r JOIN e ON e.user_id = r.user_id AND e.seq = r.seq + 1)
    SELECT user_id, seq, receipt_hash FROM r""",
)
def append(t):
    """Receipts of all events, a chain for each user, appended in two runs."""
    e = t.events.select("user_id", "event_id", "event_type", F.concat(F.lit("u"), "user_id").alias("actor"), F.col("event_id").cast("string").alias("payload"))
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    empty = t.spark.createDataFrame([], "user_id long, seq long, event_type string, actor string, payload string, payload_hash string, previous_hash string, receipt_hash string")
    old = W.append_events(empty, first.where("rn <= 3"), "user_id", ["event_id"])
    return old.unionByName(W.append_events(old, first.where("rn > 3"), "user_id", ["event_id"])).select("user_id", "seq", "receipt_hash")


@query("B03_current_capture", "SELECT source AS source_id, count(*) AS captures, max(doc_id) AS current_capture FROM documents GROUP BY source")
def captures(t):
    caps = t.documents.select(F.col("source").alias("source_id"), F.col("doc_id").alias("capture_id"))
    old, new = caps.where("capture_id % 2 = 0"), caps
    return L.insert_missing(old, new, ["capture_id"]).groupBy("source_id").agg(F.count("*").alias("captures"), F.max("capture_id").alias("current_capture"))


@query("B02_register_source", f"WITH {ctes('sources')} SELECT id, CASE WHEN n % 2 = 0 THEN 'renamed' ELSE title END AS title, status FROM sources")
def register(t):
    s = view(t, "sources").select("id", "title", "status")
    new = view(t, "sources").where("n % 2 = 0").select("id", F.lit("renamed").alias("title"), F.lit("active").alias("status"))
    return L.upsert(s, new, ["id"], keep=["status"])


@query("E02_keyword_chunk_source", f"WITH {ctes('chunks', 'sources')} SELECT c.chunk_id, s.title AS source_title FROM chunks c JOIN sources s ON s.id = c.source_id WHERE c.status = 'active' AND list_contains(regexp_extract_all(lower(c.text), '{T.TOKEN}'), 'the')")
def keyword_join(t):
    c = view(t, "chunks")
    return R.with_sources(R.keyword_chunks(c, "the"), c, view(t, "sources")).select("chunk_id", "source_title")


@query(
    "E06_edge_evidence",
    f"WITH {ctes('conflicts', 'chunks', 'sources')} SELECT k.conflict_id, c.title, s.title AS source_title FROM conflicts k LEFT JOIN chunks c ON c.chunk_id = k.object_id + 1 LEFT JOIN sources s ON s.id = c.source_id",
)
def edge_evidence(t):
    """Rows that point at chunks keep their place where a chunk is gone."""
    rows = view(t, "conflicts").select("conflict_id", (F.col("object_id") + 1).alias("chunk_id"))
    return R.located(rows, view(t, "chunks"), view(t, "sources")).select("conflict_id", "title", "source_title")


@query("E09_documents_with_chunks", "SELECT d.doc_id, count(e.vec_id) AS chunks FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.doc_id")
def with_chunks(t):
    return L.with_counts(t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "chunks")


@query("E21_semi_join", "SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)")
def semi(t):
    o = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    s = t.supplier.where("s_nationkey < 10").select(F.col("s_suppkey").alias("l_suppkey"))
    return L.only_keys(L.only_keys(t.lineitem, o, "l_orderkey"), s, "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("G02_best_per_key", "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def best(t):
    return R.best_per_key(t.events, F.struct("event_type", "user_id"), [F.desc("value"), F.col("event_id")]).select("event_type", "user_id", "event_id", "value")


@query("G04_previous_tail", "SELECT conv_id, turn, coalesce(regexp_replace(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 250), '^\\s+|\\s+$', '', 'g'), '') AS tail FROM conversations")
def previous(t):
    tail = C.previous_tail("conv_id", "turn", 250)
    return t.conversations.select("conv_id", "turn", F.coalesce(tail, F.lit("")).alias("tail"))


@query("H02_severity_sort", f"WITH {ctes('conflicts')}, r AS (SELECT *, row_number() OVER (PARTITION BY conflict_type ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, conflict_id DESC) AS pos FROM conflicts WHERE status IN ('open', 'acknowledged')) SELECT conflict_type, conflict_id, pos FROM r")
def severity(t):
    return L.conflict_listing(view(t, "conflicts"), "conflict_type").select("conflict_type", "conflict_id", "pos")


@query("H03_source_sort", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 25")
def source_sort(t):
    return L.listed(t.part, [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")], 25).select("p_partkey", "p_size", "p_retailprice")


@query("H07_ledger_list", "SELECT event_id, event_type, CAST(ts AS VARCHAR) IS NOT NULL AS dated FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def ledger_list(t):
    return L.listed(t.events, [F.desc("ts"), F.desc("event_id")], 25).select("event_id", "event_type", F.col("ts").isNotNull().alias("dated"))


@query("H08_detail", "SELECT o_orderkey, count(l_orderkey) AS items, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def detail(t):
    j = L.with_details(t.orders.select("o_orderkey"), t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_linenumber")
    return j.select("o_orderkey", "items", F.array_join("details", ",").alias("lines"))


@query("I02_distinct_objects", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct(t):
    return L.changed_objects(t.lineitem, "l_suppkey", "l_returnflag")


@query("I03_intersection", "SELECT l_partkey, l_returnflag FROM lineitem WHERE l_suppkey % 2 = 1 INTERSECT SELECT l_partkey, l_returnflag FROM lineitem WHERE l_suppkey % 2 = 0")
def intersection(t):
    side = lambda k: t.lineitem.where(F.col("l_suppkey") % 2 == k)
    return L.shared_keys(side(1), side(0), ["l_partkey", "l_returnflag"])


@query(
    "I04_outer_merge",
    """WITH a AS (SELECT event_type, user_id, max(value) AS x FROM events GROUP BY 1, 2), b AS (SELECT event_type, user_id % 7 * 3 AS user_id, count(*) AS y FROM events GROUP BY 1, 2),
    u AS (SELECT event_type, user_id, x / CASE WHEN max(x) OVER (PARTITION BY event_type) > 0 THEN max(x) OVER (PARTITION BY event_type) ELSE 1 END AS x, 0.0 AS y FROM a
          UNION ALL SELECT event_type, user_id, 0.0, y / max(y) OVER (PARTITION BY event_type) FROM b)
    SELECT event_type, user_id, round(max(x), 6) AS vector, round(max(y), 6) AS keyword FROM u GROUP BY 1, 2""",
)
def outer_merge(t):
    a = t.events.groupBy("event_type", F.col("user_id").alias("doc_id")).agg(F.max("value").alias("score"))
    b = t.events.groupBy("event_type", (F.col("user_id") % 7 * 3).alias("doc_id")).agg(F.count("*").cast("double").alias("score"))
    return R.fuse(a, b, by="event_type").select("event_type", F.col("chunk_id").alias("user_id"), F.round("vector", 6).alias("vector"), F.round("keyword", 6).alias("keyword"))


@query("J08_library_search", "SELECT 'part' AS name, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'build') UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE contains(lower(s_name), 'build') UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE contains(lower(c_mktsegment || ' ' || c_name), 'build')")
def library(t):
    tables = {"part": (t.part, "p_partkey", ["p_name", "p_type", "p_brand"]), "supplier": (t.supplier, "s_suppkey", ["s_name"]), "customer": (t.customer, "c_custkey", ["c_mktsegment", "c_name"])}
    return R.search_records(tables, "Build")


@query("K05_proposed_edges", f"WITH k AS (SELECT doc_id, lower(text) AS low FROM documents), u AS (SELECT 'doc:' || doc_id AS source_id, 'relates_to' AS relation, unnest([{', '.join(repr(c) for c in T.PROPOSAL_CONCEPTS)}]) AS target_id, unnest([{', '.join('(' + ' OR '.join(f'contains(low, {w!r})' for w in ws) + ')' for ws in T.PROPOSAL_CONCEPTS.values())}]) AS hit FROM k) SELECT * FROM u WHERE hit")
def proposed(t):
    hits = t.documents.select(F.concat(F.lit("doc:"), "doc_id").alias("source_id"), F.explode(T.concepts(F.lower("text"), T.PROPOSAL_CONCEPTS)).alias("target_id"))
    return hits.select("source_id", F.lit("relates_to").alias("relation"), "target_id", F.lit(True).alias("hit"))


@query(
    "N06_field_map_check",
    """SELECT 'c' || n_nationkey AS client_id, 'contact' AS object, 'created_at' AS field, 'missing field' AS problem FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT 'c' || n_nationkey, 'ticket', '', 'unknown object' FROM nation WHERE n_nationkey % 3 = 0""",
)
def field_map(t):
    """Field maps of one client for each nation: a required field is not mapped by some, an unknown object is by others."""
    client = F.concat(F.lit("c"), "n_nationkey").alias("client_id")
    row = lambda where, obj, field: t.nation.where(where).select(client, F.lit(obj).alias("object"), F.lit(field).alias("field"))
    maps = row("true", "contact", "id").unionByName(row("n_nationkey % 2 = 1", "contact", "created_at")).unionByName(row("n_nationkey % 3 = 0", "ticket", "id"))
    return N.missing_fields(maps)


@query("N10_stale_evidence", "SELECT event_id FROM events WHERE (epoch_us(TIMESTAMP '2024-02-10 12:00:00') - epoch_us(ts)) / 3600e6 > CASE event_type WHEN 'purchase' THEN 240 WHEN 'view' THEN 480 ELSE 800 END")
def stale_evidence(t):
    sla = t.spark.createDataFrame([("purchase", 240), ("view", 480)], "event_type string, sla int")
    j = t.events.join(F.broadcast(sla), "event_type", "left")
    status = V.freshness_status(F.col("ts"), F.coalesce("sla", F.lit(800)), F.lit("2024-02-10 12:00:00").cast("timestamp"))
    return j.where(status == "stale").select("event_id")


@query("O01_signal_windows", "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def signal_windows(t):
    return S.signal_windows(t.events).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "O02_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, sid, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""",
)
def sessions(t):
    return S.sessions(t.events).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("O03_fresh_captures", "SELECT count(DISTINCT sha256(text)) AS n FROM documents")
def fresh(t):
    return S.fresh_captures(t.documents.select("doc_id", "text"), "doc_id").agg(F.count("*").alias("n"))
