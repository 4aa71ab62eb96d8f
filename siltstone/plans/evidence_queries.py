"""Queries of entities, relations, operational evidence and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as E
from ..operators import evidence as V
from ..operators import governance as G
from ..operators import relations as R
from ..operators import runs as U
from ..shared import scratch
from ..sources.store import Store
from .registry import query
from .retrieval_queries import NOW, now
from .standins import ctes, view
from .text_queries import blocks_sql, likely_sql, without

# --- entities --------------------------------------------------------------------------------------------------

ENT = f"""ge AS (SELECT node_id, type, name, alias, origin, normalized FROM (SELECT *, row_number() OVER (PARTITION BY node_id, normalized ORDER BY origin DESC, alias) AS rn FROM (
    SELECT *, {without('alias', T.ENTITY_STOP)} AS normalized FROM (SELECT id AS node_id, type, name, name AS alias, 'name' AS origin FROM nodes WHERE status IN ('active', 'provisional')
    UNION ALL SELECT n.id, n.type, n.name, a.alias, 'alias' FROM nodes n JOIN aliases a ON a.node_id = n.id WHERE n.status IN ('active', 'provisional'))) WHERE length(normalized) >= 3) WHERE rn = 1)"""


@query("I01_graph_entities", f"WITH {ctes('nodes', 'aliases')}, {ENT} SELECT node_id, alias, origin, normalized FROM ge")
def graph_entities(t):
    return E.graph_entities(view(t, "nodes"), view(t, "aliases")).select("node_id", "alias", "origin", "normalized")


@query("D11_known_mentions")
def known_mentions(t):
    """Mentions of the benchmark's first words in the documents, with offsets; the offsets need a regular expression with boundaries."""
    first = F.regexp_extract("text", r"\w+\W+\w+", 0)
    names = t.benchmark.select(F.concat(F.lit("bench:"), "item_id").alias("node_id"), first.alias("alias"), F.lit("name").alias("origin")).where("alias != ''")
    return E.known_mentions(view(t, "chunks"), names)


@query("D12_pattern_mentions")
def pattern_mentions(t):
    """No SQL: the word boundary knows letters of all scripts, which DuckDB's does not."""
    return E.pattern_mentions(view(t, "chunks"))


_MENT = f"""me AS (SELECT o_orderkey AS mention_id, {without("'The ' || CASE WHEN o_orderkey % 5 = 0 THEN 'Nobody#' ELSE 'Customer#' END || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' Inc'", T.ENTITY_STOP)} AS normalized,
    CASE WHEN o_orderkey % 7 = 0 THEN 'customer:' || (o_custkey + 1) END AS hint FROM orders)"""


def _mentions(t):
    name = F.concat(F.lit("The "), F.when(F.col("o_orderkey") % 5 == 0, "Nobody#").otherwise("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" Inc"))
    return t.orders.select(
        F.col("o_orderkey").alias("mention_id"), T.normalize_entity(name).alias("normalized"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("customer:"), F.col("o_custkey") + 1)).alias("hint"),
    )


_CAND = """ca AS (SELECT mention_id, node_id, max(score) AS score, arg_max(method, score) AS method FROM (
    SELECT mention_id, node_id, 0.99 AS score, 'extractor_hint' AS method FROM me JOIN (SELECT DISTINCT node_id FROM ge) g ON g.node_id = me.hint
    UNION ALL SELECT mention_id, node_id, 0.97, 'exact_alias' FROM me JOIN (SELECT DISTINCT node_id, normalized FROM ge) g ON g.normalized = me.normalized) GROUP BY mention_id, node_id)"""


@query("E16_resolution_candidates", f"WITH {ctes('nodes', 'aliases')}, {ENT}, {_MENT}, {_CAND} SELECT mention_id, node_id, CAST(score AS DOUBLE) AS score, method FROM ca")
def candidates(t):
    return E.resolution_candidates(_mentions(t), E.graph_entities(view(t, "nodes"), view(t, "aliases")), fuzzy=False)


@query(
    "G09_resolution_decision",
    f"""WITH {ctes('nodes', 'aliases')}, {ENT}, {_MENT}, {_CAND}, r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second, count(*) OVER (PARTITION BY mention_id) AS n FROM ca WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, node_id)),
    d AS (SELECT mention_id, node_id, CASE WHEN n = 1 AND score >= 0.95 OR n > 1 AND score >= 0.95 AND second < 0.95 AND score - second >= 0.1 THEN 'accepted' ELSE 'needs_review' END AS status FROM r WHERE rn = 1)
    SELECT me.mention_id, coalesce(status, 'unresolved') AS status, node_id FROM me LEFT JOIN d USING (mention_id)""",
)
def decisions(t):
    m = _mentions(t)
    return E.resolve(m, E.resolution_candidates(m, E.graph_entities(view(t, "nodes"), view(t, "aliases")), fuzzy=False))


_FUZZY = f"""WITH RECURSIVE {{ctes}}, {ENT}, {_MENT},
    mf AS (SELECT mention_id, regexp_replace(normalized, '^customer', 'custumer') AS normalized, hint FROM me), mt AS (SELECT DISTINCT normalized FROM mf WHERE normalized <> ''), gt AS (SELECT DISTINCT normalized FROM ge),
    y AS (SELECT mt.normalized AS l, gt.normalized AS r FROM mt JOIN gt ON mt.normalized <> gt.normalized AND {likely_sql('mt.normalized', 'gt.normalized', 0.9)}), {blocks_sql('y')},
    ca AS (SELECT mention_id, node_id, max(score) AS score, arg_max(method, score) AS method FROM (
    SELECT mention_id, node_id, 0.99::DOUBLE AS score, 'extractor_hint' AS method FROM mf JOIN (SELECT DISTINCT node_id FROM ge) g ON g.node_id = mf.hint
    UNION ALL SELECT mention_id, node_id, 0.97, 'exact_alias' FROM mf JOIN (SELECT DISTINCT node_id, normalized FROM ge) g ON g.normalized = mf.normalized
    UNION ALL SELECT mention_id, node_id, ratio, 'fuzzy_alias' FROM mf JOIN blocks ON l = mf.normalized JOIN (SELECT DISTINCT node_id, normalized FROM ge) g ON g.normalized = r WHERE ratio >= 0.9) GROUP BY mention_id, node_id)"""


def _misspelled(t):
    return _mentions(t).withColumn("normalized", F.regexp_replace("normalized", "^customer", "custumer"))


@query("E16_fuzzy_candidates", _FUZZY.replace("{ctes}", ctes("nodes", "aliases")) + " SELECT mention_id, node_id, round(score, 9) AS score, method FROM ca")
def fuzzy_candidates(t):
    """Candidates of mentions with one letter changed: hints, equal texts and close ones by the ratio of matching blocks."""
    found = E.resolution_candidates(_misspelled(t), E.graph_entities(view(t, "nodes"), view(t, "aliases")))
    return found.select("mention_id", "node_id", F.round("score", 9).alias("score"), "method")


@query(
    "L11_fuzzy_resolution",
    _FUZZY.replace("{ctes}", ctes("nodes", "aliases"))
    + """, r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second, count(*) OVER (PARTITION BY mention_id) AS n FROM ca WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, node_id)),
    d AS (SELECT mention_id, node_id, CASE WHEN n = 1 AND score >= 0.95 AND method IN ('exact_alias', 'extractor_hint') OR n > 1 AND score >= 0.95 AND second < 0.95 AND score - second >= 0.1 THEN 'accepted' ELSE 'needs_review' END AS status FROM r WHERE rn = 1)
    SELECT me.mention_id, coalesce(status, 'unresolved') AS status, node_id FROM me LEFT JOIN d USING (mention_id)""",
)
def fuzzy(t):
    """Resolution with close spellings (one letter of each name is changed)."""
    m = _misspelled(t)
    return E.resolve(m, E.resolution_candidates(m, E.graph_entities(view(t, "nodes"), view(t, "aliases"))))


_EM = "em AS (SELECT 'supplier:' || l_suppkey AS node_id, l_orderkey AS chunk_id, lower(l_returnflag) AS normalized, l_discount AS confidence, 'ann:' || l_orderkey || ':' || l_linenumber AS annotation FROM lineitem)"


def _accepted(t):
    return t.lineitem.select(
        F.concat(F.lit("supplier:"), "l_suppkey").alias("node_id"), F.col("l_orderkey").alias("chunk_id"), F.lower("l_returnflag").alias("normalized"),
        F.col("l_discount").alias("confidence"), F.concat(F.lit("ann:"), "l_orderkey", F.lit(":"), "l_linenumber").alias("annotation"),
    )


@query(
    "F04_mention_hints",
    f"""WITH {_EM}, g AS (SELECT node_id, normalized, count(*) AS n, max(annotation) AS annotation, arg_max(confidence, annotation) AS confidence FROM em GROUP BY node_id, normalized),
    r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, confidence DESC, normalized) AS rn FROM g)
    SELECT node_id, normalized, n, annotation, least(1.0, 0.65 + 0.05 * n)::DOUBLE AS score FROM r WHERE rn = 1 ORDER BY n DESC, node_id LIMIT 50""",
)
def mention_hints(t):
    return E.mention_hints(_accepted(t), 50)


@query("F05_entity_scores", f"WITH {_EM}, g AS (SELECT chunk_id, node_id, count(*) AS n, max(confidence) AS c FROM em GROUP BY 1, 2) SELECT chunk_id, round(max(least(1.0, 0.55 + 0.15 * n + 0.2 * c)), 6) AS entity FROM g GROUP BY chunk_id")
def entity_scores(t):
    from ..operators.retrieval import entity_chunk_scores

    return entity_chunk_scores(_accepted(t)).select("chunk_id", F.round("entity", 6).alias("entity"))


@query("G08_top_chunks", f"WITH {_EM}, g AS (SELECT node_id, chunk_id, count(*) AS n, max(confidence) AS confidence FROM em GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC, n DESC, chunk_id) AS rank FROM g) SELECT node_id, chunk_id, n, confidence, rank FROM r WHERE rank <= 3")
def top_chunks(t):
    return E.top_chunks_per_entity(_accepted(t), 3)


@query("E08_unscanned_chunks", "SELECT doc_id AS chunk_id, sha256(text) AS text_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unscanned(t):
    c = t.documents.select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("text_hash"))
    seen = c.join(t.labels.where("quality = 1").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    changed = t.labels.where("quality = 0").select(F.col("doc_id").alias("chunk_id"), F.lit("old").alias("text_hash"))
    return E.unscanned(c, seen.unionByName(changed))


# --- relations -------------------------------------------------------------------------------------------------

# Sentences made of the supplied names, so that every pattern has something to find.
_S = """SELECT c_custkey AS chunk_id, 'Customer ' || c_mktsegment || CASE c_custkey % 5 WHEN 0 THEN ' Group acquired Supplier Labs. ' WHEN 1 THEN ' Group is led by John Smith. ' WHEN 2 THEN ' was headquartered in London. '
    WHEN 3 THEN ' is a client of Part Cloud and ' ELSE ' runs on Acme Database. ' END || 'Then Nation N' || c_nationkey || ' partnered with Region R. ' AS text FROM customer"""


def _sentences(t):
    return t.spark.sql(_S.replace("FROM customer", "FROM {customer}"), customer=t.customer)


def _pattern_sql(p: str) -> str:
    rx = R.pattern(p).replace("'", "''")
    clean = lambda g: f"""trim(regexp_replace(regexp_extract(m, '{rx}', {g}), '\\s+', ' ', 'g'), ' ,.;:()[]{{}}"''')"""
    return f"SELECT chunk_id, '{p}' AS predicate, {clean(1)} AS subject, {clean(3)} AS object FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '{rx}')) AS m FROM s)"


_REL = f"s AS ({_S}), rel AS ({' UNION ALL '.join(_pattern_sql(p) for p in R.PATTERNS)})"


@query("D13_relation_claims", f"WITH {_REL} SELECT chunk_id, subject, predicate, object, 0.82 AS confidence FROM rel")
def relation_claims(t):
    return R.extract_relations(_sentences(t)).select("chunk_id", "subject", "predicate", "object", "confidence")


def _ends(text: str) -> list[tuple[str, str, str, float]]:
    words = text.split(" ")
    return [(words[0], "ends_with", words[-1], 0.5)] if len(words) > 1 else []


@query("P01_table_function", f"WITH s AS ({_S}), w AS (SELECT chunk_id, string_split(text, ' ') AS w FROM s) SELECT chunk_id, w[1] AS subject, 'ends_with' AS predicate, w[-1] AS object, 0.5::DOUBLE AS confidence FROM w WHERE len(w) > 1")
def table_function(t):
    """An extractor of one's own, called from SQL over any table with texts."""
    t.spark.udtf.register("sentence_ends", R.extractor_function(_ends))
    return t.spark.sql("SELECT chunk_id, subject, predicate, object, confidence FROM sentence_ends(TABLE(SELECT chunk_id, text FROM {s}))", s=_sentences(t).select("chunk_id", "text"))


#: A later state of the sentences: every ninth has grown by a claim, every eleventh is gone.
_LATER = f"SELECT chunk_id, CASE WHEN chunk_id % 9 = 0 THEN text || ' Acme Group acquired Beta Corp.' ELSE text END AS text FROM ({_S}) WHERE chunk_id % 11 <> 0"


@query(
    "L12_extraction_run",
    f"WITH {_REL.replace(f's AS ({_S})', f's AS ({_LATER})')} SELECT DISTINCT chunk_id, subject, predicate, object, 0.82::DOUBLE AS confidence, 'candidate' AS status, true AS annotated FROM rel WHERE subject <> '' AND object <> ''",
)
def extraction_run(t):
    """The candidates that are stored after a second run, which looks at changed sentences only, each with its annotation."""
    store = Store(t.spark, scratch(t.spark, "relations"), 16)
    s = _sentences(t)
    U.extraction_run(store, s, R.ontology(t.spark))
    later = s.where("chunk_id % 11 <> 0").withColumn("text", F.when(F.col("chunk_id") % 9 == 0, F.concat("text", F.lit(" Acme Group acquired Beta Corp."))).otherwise(F.col("text")))
    U.extraction_run(store, later, R.ontology(t.spark))
    notes = store.read("annotations").select("annotation_id", F.lit(True).alias("annotated"))
    return store.read("candidates").join(notes, "annotation_id", "left").select("chunk_id", "subject", "predicate", "object", "confidence", "status", "annotated")


@query("C25_normalize_predicate", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'acquired' WHEN 1 THEN 'based_in' WHEN 2 THEN 'uses' ELSE 'talked_to' END AS predicate FROM orders")
def predicates(t):
    verb = F.element_at(F.array(*map(F.lit, ["Bought", "headquartered in", "runs on", "Talked to"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return R.normalize_predicate(t.orders.select("o_orderkey", verb.alias("predicate")), R.ontology(t.spark))


_CANDS = "SELECT o_orderkey AS candidate_id, 'Customer ' || o_custkey AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'led_by' WHEN 1 THEN 'uses' ELSE 'sings' END AS predicate, o_orderpriority AS object, CASE WHEN o_orderkey % 4 = 0 THEN 'location' ELSE 'organization' END AS subject_type, CASE o_orderkey % 3 WHEN 0 THEN 'person' ELSE 'product' END AS object_type, 0.5 + (o_orderkey % 10) / 20.0 AS confidence FROM orders"


def _cands(t):
    return t.spark.sql(_CANDS.replace("FROM orders", "FROM {orders}"), orders=t.orders).withColumn("confidence", F.col("confidence").cast("double"))


@query(
    "G05_promotion",
    f"""WITH c AS ({_CANDS}), v AS (SELECT *, lower(subject) AS skey, CASE WHEN predicate = 'sings' THEN 'unknown_predicate' WHEN confidence < 0.7 THEN 'low_confidence' WHEN subject_type = 'location' THEN 'subject_type_not_allowed' END AS r FROM c),
    f AS (SELECT *, first_value(CASE WHEN r IS NULL THEN lower(object) END) OVER (PARTITION BY skey, predicate ORDER BY r IS NOT NULL, confidence DESC, candidate_id) AS first FROM v),
    g AS (SELECT candidate_id, CASE WHEN r IS NULL AND predicate = 'led_by' AND first <> lower(object) THEN 'cardinality_conflict' ELSE r END AS reason FROM f)
    SELECT candidate_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'needs_review' END AS status, reason FROM g""",
)
def promotion(t):
    return R.promote(_cands(t), R.ontology(t.spark))


@query("J10_find_relations", f"WITH c AS ({_CANDS}) SELECT subject, predicate, object, CAST(confidence AS DOUBLE) AS confidence FROM c WHERE contains(lower(subject), 'customer 1') AND predicate = 'uses' AND contains(lower(subject || ' ' || predicate || ' ' || object), 'high') ORDER BY confidence DESC, subject, predicate, object LIMIT 20")
def find_relations(t):
    return R.find_relations(_cands(t), "Customer 1", "uses", words=("HIGH",)).select("subject", "predicate", "object", "confidence")


@query("E17_shared_relations", f"WITH c AS ({_CANDS}), k AS (SELECT subject, predicate, regexp_replace(trim(regexp_replace(lower(object), '[^a-z0-9]+', ' ', 'g')), '^$', '') AS object_key, max(CAST(confidence AS DOUBLE)) AS m FROM c GROUP BY ALL) SELECT a.predicate, a.object_key, a.m AS left_confidence, b.m AS right_confidence FROM k a JOIN k b ON a.predicate = b.predicate AND a.object_key = b.object_key WHERE a.subject = 'Customer 1' AND b.subject = 'Customer 2'")
def shared(t):
    return R.shared_relations(_cands(t), "Customer 1", "The Customer 2")


# --- operational evidence --------------------------------------------------------------------------------------

_ADS = "SELECT l_suppkey, CAST(floor(l_extendedprice * 1000000) AS BIGINT) AS cost_micros, CAST(l_quantity * 10 AS BIGINT) AS impressions, CAST(l_quantity AS BIGINT) AS clicks, l_discount AS conversions, l_tax * 100 AS conversions_value, CASE WHEN l_returnflag = 'R' THEN 'Lead_Form  Submit' WHEN l_returnflag = 'A' THEN 'demo' ELSE 'Newsletter' END AS conversion_name FROM lineitem"


def _ads(t):
    return t.spark.sql(_ADS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem)


@query(
    "F06_ads_metrics",
    f"""WITH a AS ({_ADS}), s AS (SELECT l_suppkey, round(sum(cost_micros) / 1000000, 2) AS spend, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, sum(conversions) AS cv, sum(conversions_value) AS vl FROM a GROUP BY 1)
    SELECT l_suppkey, spend, impressions, clicks, round(clicks / impressions, 4) AS ctr, round(spend / clicks, 2) AS cpc, round(spend * 1000 / impressions, 2) AS cpm, round(cv, 4) AS conversions, round(vl, 2) AS conversion_value, round(cv / clicks, 4) AS conversion_rate FROM s""",
)
def ads(t):
    return V.ads_metrics(_ads(t), ["l_suppkey"])


@query(
    "F07_mapped_conversions",
    f"""WITH a AS ({_ADS}), w AS (SELECT *, CASE conversion_name WHEN 'Lead_Form  Submit' THEN 2.0 WHEN 'demo' THEN 0.5 END AS wt FROM a)
    SELECT l_suppkey, round(coalesce(sum(conversions * wt), 0), 4) AS conversions, round(coalesce(sum(conversions_value * wt), 0), 2) AS conversion_value, count(*) FILTER (wt IS NULL) AS ignored_rows FROM w GROUP BY 1""",
)
def mapped(t):
    d = t.spark.createDataFrame([("lead form submit", 2.0, 0), ("Demo", 0.5, 1), ("demo", 9.0, 2)], "name string, weight double, priority int")
    return V.mapped_conversions(_ads(t), d, ["l_suppkey"])


_AN = "SELECT event_type, CAST(user_id % 50 AS BIGINT) AS sessions, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS key_events, CASE WHEN event_id % 9 > 0 THEN (event_id % 100) / 100.0 END AS engagement_rate FROM events"


@query(
    "F08_analytics_metrics",
    f"""WITH a AS ({_AN}), s AS (SELECT event_type, sum(sessions)::BIGINT AS sessions, sum(key_events)::BIGINT AS key_events, sum(engagement_rate * sessions) FILTER (sessions > 0) AS er, sum(sessions) FILTER (sessions > 0 AND engagement_rate IS NOT NULL) AS w FROM a GROUP BY 1)
    SELECT event_type, sessions, key_events, round(CAST(er AS DOUBLE) / w, 4) AS engagement_rate, round(key_events / sessions, 4) AS conversion_rate FROM s""",
)
def analytics(t):
    rows = t.spark.sql(_AN.replace("FROM events", "FROM {events}"), events=t.events).withColumn("engagement_rate", F.col("engagement_rate").cast("double"))
    return V.analytics_metrics(rows, ["event_type"])


@query(
    "F12_crm_metrics",
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS leads, count(*) FILTER (c_mktsegment = 'BUILDING') AS mqls, count(*) FILTER (c_mktsegment = 'MACHINERY') AS sqls FROM customer GROUP BY 1),
    d AS (SELECT c_nationkey AS k, count(*) AS opportunities, round(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END), 2) AS pipeline_amount,
        round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS closed_won_revenue FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
    SELECT k AS client_id, leads, mqls, sqls, coalesce(opportunities, 0) AS opportunities, coalesce(pipeline_amount, 0) AS pipeline_amount, coalesce(closed_won_revenue, 0) AS closed_won_revenue FROM c LEFT JOIN d USING (k)""",
)
def crm(t):
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "Marketing-Qualified Lead").when(F.col("c_mktsegment") == "MACHINERY", "sales qualified lead").otherwise("subscriber")
    contacts = t.customer.select(F.col("c_nationkey").alias("client_id"), seg.alias("stage"))
    deals = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("client_id"), F.col("o_totalprice").cast("string").alias("amount"), F.when(F.col("o_orderstatus") == "F", "closed lost").when(F.col("o_orderstatus") == "O", "Closed Won").otherwise("open").alias("stage")
    )
    return V.crm_metrics(contacts, deals, deals, "client_id")


@query(
    "F09_contact_hygiene",
    """SELECT c_nationkey, count(*) AS contacts, count(DISTINCT c_custkey % 40) AS accounts, count(*) FILTER (c_custkey % 9 < 2) AS missing_email_count, count(*) FILTER (c_mktsegment IN ('BUILDING', 'FURNITURE')) AS suppressed_count,
       count(*) FILTER (c_custkey % 60 > 40) AS stale_record_count FROM customer GROUP BY 1""",
)
def hygiene(t):
    rows = t.customer.select(
        "c_nationkey", (F.col("c_custkey") % 40).alias("account_id"), F.when(F.col("c_custkey") % 9 == 0, None).when(F.col("c_custkey") % 9 == 1, "").otherwise(F.col("c_name")).alias("email"),
        F.col("c_mktsegment").alias("email_status"), F.date_sub(F.lit("2024-03-01").cast("date"), (F.col("c_custkey") % 60).cast("int")).alias("updated_at"),
    )
    return V.contact_hygiene(rows, ["c_nationkey"], ("building", "furniture"), F.lit("2024-01-21").cast("date"))


@query("F10_signal_rollup", "SELECT event_type, count(*) AS buyer_signal_count, round(avg(value), 6) AS avg_signal_strength, count(DISTINCT user_id % 97) AS accounts, count(DISTINCT user_id) AS contacts FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1")
def signals(t):
    from ..functions.dates import in_window

    rows = t.events.where(in_window(F.to_date("ts"), "2024-01-05", "2024-01-20")).select("event_type", F.col("value").alias("strength"), (F.col("user_id") % 97).alias("account_id"), F.col("user_id").alias("contact_id"))
    return V.signal_rollup(rows, ["event_type"]).withColumn("avg_signal_strength", F.round("avg_signal_strength", 6))


@query("F11_outcome_rollup", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS leads, round(sum(l_extendedprice), 1) AS pipeline_amount, round(sum(l_discount) / nullif(sum(l_quantity), 0), 8) AS conversion_rate FROM lineitem GROUP BY 1, 2")
def outcomes(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("leads"), F.col("l_extendedprice").alias("pipeline_amount"), "l_discount")
    out = V.outcome_rollup(rows, ["l_returnflag", "l_linestatus"], ["leads", "pipeline_amount"], "l_discount", "leads")
    return out.select("l_returnflag", "l_linestatus", F.round("leads", 2).alias("leads"), F.round("pipeline_amount", 1).alias("pipeline_amount"), F.round("conversion_rate", 8).alias("conversion_rate"))


_MET = """SELECT 'c' || n_nationkey AS client_id, 'crm' AS kind, 'crm_a' AS provider, 'leads' AS metric, CAST(n_nationkey * 3 AS DOUBLE) AS value FROM nation
    UNION ALL SELECT 'c' || n_nationkey, 'ads', 'ads_a', 'leads', CAST(n_nationkey * n_nationkey AS DOUBLE) FROM nation
    UNION ALL SELECT 'c' || n_nationkey, 'ads', 'ads_b', 'conversions', CAST(20 + n_nationkey AS DOUBLE) FROM nation
    UNION ALL SELECT 'c' || n_nationkey, 'analytics', 'web', 'conversions', CAST(30 AS DOUBLE) FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT 'c' || n_nationkey, 'analytics', 'web', 'key_events', CAST(12 AS DOUBLE) FROM nation
    UNION ALL SELECT 'c' || n_nationkey, 'ads', 'ads_a', 'spend', CAST(n_nationkey AS DOUBLE) FROM nation
    UNION ALL SELECT 'c' || n_nationkey, 'analytics', 'web', 'sessions', CAST(100 AS DOUBLE) FROM nation WHERE n_nationkey % 3 = 0
    UNION ALL SELECT 'c' || n_nationkey, 'analytics', 'web', 'leads', CAST(7 AS DOUBLE) FROM nation"""


def _metrics(t):
    return t.spark.sql(_MET.replace("FROM nation", "FROM {nation}"), nation=t.nation)


@query(
    "F13_reconciliation",
    f"""WITH m AS ({_MET}), w AS (SELECT client_id, sum(value) FILTER (kind = 'crm' AND metric = 'leads') AS cl, sum(value) FILTER (kind = 'ads' AND metric = 'leads') AS al, sum(value) FILTER (kind = 'ads' AND metric = 'conversions') AS ac,
        sum(value) FILTER (kind = 'analytics' AND metric = 'conversions') AS nc, sum(value) FILTER (kind = 'analytics' AND metric = 'key_events') AS nk, coalesce(sum(value) FILTER (kind = 'ads' AND metric = 'spend'), 0) AS sp,
        coalesce(sum(value) FILTER (kind = 'analytics' AND metric = 'sessions'), 0) AS ss FROM m GROUP BY 1),
    r AS (SELECT client_id, 'crm_vs_ad_leads' AS conflict_type, abs(al - cl) / greatest(abs(cl), 1) AS d, 0.1 AS lo, 0.35 AS hi FROM w
        UNION ALL SELECT client_id, 'ads_vs_analytics_conversions', abs(ac - nc) / greatest(abs(nc), 1), 0.2, 0.5 FROM w UNION ALL SELECT client_id, 'analytics_vs_crm_leads', abs(coalesce(nc, nk) - cl) / greatest(abs(cl), 1), 0.2, 0.5 FROM w)
    SELECT client_id, conflict_type, CASE WHEN d < hi THEN 'medium' ELSE 'high' END AS severity, round(d, 4) AS relative_delta FROM r WHERE d >= lo
    UNION ALL SELECT client_id, 'ad_spend_without_sessions', 'high', NULL FROM w WHERE sp > 0 AND ss <= 0""",
)
def reconciliation(t):
    return V.reconcile(_metrics(t))


_RANK = "CASE kind WHEN 'crm' THEN 0 WHEN 'analytics' THEN 1 ELSE 2 END"


@query("F14_selected_metrics", f"WITH m AS ({_MET}), r AS (SELECT *, row_number() OVER (PARTITION BY client_id, metric ORDER BY {_RANK}, provider) AS rn, string_agg(provider, ',') OVER (PARTITION BY client_id, metric ORDER BY {_RANK}, provider ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS candidates FROM m) SELECT client_id, metric, provider, value, candidates FROM r WHERE rn = 1")
def selected(t):
    return V.selected_metrics(_metrics(t), ["crm", "analytics"])


@query(
    "F15_data_quality",
    f"""WITH {ctes('conflicts')}, k AS (SELECT source AS client_id, bool_or(severity = 'high') AS high FROM conflicts c JOIN documents d ON d.doc_id = c.object_id WHERE c.status IN ('open', 'acknowledged') AND c.conflict_type = 'contradiction' GROUP BY 1),
    c AS (SELECT DISTINCT source AS client_id, CAST(substr(source, 4) AS INT) % 2 = 0 AS p FROM documents)
    SELECT client_id, CASE WHEN high IS NOT NULL AND p THEN 'partial_conflicted' WHEN high IS NOT NULL THEN 'conflicted' WHEN p THEN 'partial' ELSE 'ok' END AS quality,
        CAST(CASE WHEN p AND high THEN 0.35 WHEN high THEN 0.5 WHEN high IS NOT NULL AND p THEN 0.55 WHEN high IS NOT NULL THEN 0.7 WHEN p THEN 0.75 ELSE 1 END AS DOUBLE) AS score FROM c LEFT JOIN k USING (client_id)""",
)
def quality(t):
    clients = t.documents.select(F.col("source").alias("client_id"), (F.substring("source", 4, 9).cast("int") % 2 == 0).alias("partial")).distinct()
    k = view(t, "conflicts").where("conflict_type = 'contradiction'").join(t.documents.select(F.col("doc_id").alias("object_id"), F.col("source").alias("client_id")), "object_id")
    return V.data_quality(k, clients)


@query("G03_latest_evidence", "SELECT user_id AS client_id, event_type AS query_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS evidence_id, max(ts) AS fresh_at FROM events GROUP BY 1, 2")
def latest(t):
    cards = t.events.select(F.col("user_id").alias("client_id"), F.col("event_type").alias("query_id"), F.col("event_id").alias("evidence_id"), F.col("ts").alias("fresh_at"))
    return V.latest(cards, ["client_id", "query_id"])


@query("N05_freshness_status", f"SELECT event_type, CASE WHEN (epoch_us({NOW}) - epoch_us(ts)) / 3600e6 > 24 * (event_id % 40) THEN 'stale' ELSE 'fresh' END AS freshness, count(*) AS n FROM events GROUP BY ALL")
def freshness(t):
    s = V.freshness_status(F.col("ts"), 24 * (F.col("event_id") % 40), now())
    return t.events.groupBy("event_type", s.alias("freshness")).agg(F.count("*").alias("n"))


@query("N13_index_sizing", "SELECT count(*) AS chunks, count(e.vec_id) AS embedded, CAST(sum(greatest(1, ceil(length(text) / 4))) AS BIGINT) AS tokens, round(sum(greatest(1, ceil(length(text) / 4))) * 0.02 / 1000000, 8) AS cost FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def sizing(t):
    j = t.documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("n")).join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("e")), "doc_id", "left")
    return j.agg(F.count("*").alias("chunks"), F.count("e").alias("embedded"), F.sum("n").alias("tokens")).withColumn("cost", F.round(T.embedding_cost(F.col("tokens"), "text-embedding-3-small"), 8))


# --- governance ------------------------------------------------------------------------------------------------

_REQ = "SELECT event_id AS request_id, event_type AS claim_type, 'c' || (user_id % 5) AS client_id, CASE event_id % 4 WHEN 0 THEN 'crm' WHEN 1 THEN 'sheet' WHEN 2 THEN 'rumour' ELSE 'web' END AS source, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'ev' END AS evidence_id, ts AS fresh_at FROM events"


def _requests(t):
    return t.spark.sql(_REQ.replace("FROM events", "FROM {events}"), events=t.events)


def _anchors(t):
    rows = [
        ("a1", "active", "*", "*", "crm", ["sheet"], ["rumour"], 24 * 25, "warn", ["evidence_id"]),
        ("a2", "active", "purchase", "*", "web", [], ["rumour"], 24 * 20, "block_and_ask", []),
        ("a3", "active", "purchase", "c1", "sheet", ["web"], [], 24, "warn", ["evidence_id"]),
        ("a0", "draft", "purchase", "c1", "web", [], [], 1, "block", []),
    ]
    return t.spark.createDataFrame(rows, "anchor_id string, status string, scope_claim_type string, scope_client_id string, authoritative_source string, fallback_sources array<string>, forbidden_sources array<string>, freshness_sla_hours int, conflict_behavior string, required_evidence array<string>")


_ADJ = f"""r AS ({_REQ}), x AS (SELECT *, CASE WHEN claim_type = 'purchase' AND client_id = 'c1' THEN 'a3' WHEN claim_type = 'purchase' THEN 'a2' ELSE 'a1' END AS anchor_id, greatest(epoch_us({NOW}) - epoch_us(fresh_at), 0) / 3600e6 AS age FROM r),
    adj AS (SELECT request_id, anchor_id, CASE WHEN anchor_id IN ('a1', 'a2') AND source = 'rumour' THEN 'block' WHEN anchor_id IN ('a1', 'a3') AND evidence_id = '' THEN 'warn'
        WHEN anchor_id = 'a1' AND source = 'crm' THEN CASE WHEN age > 600 THEN 'warn' ELSE 'allow' END WHEN anchor_id = 'a2' AND source = 'web' THEN CASE WHEN age > 480 THEN 'warn' ELSE 'allow' END
        WHEN anchor_id = 'a3' AND source = 'sheet' THEN CASE WHEN age > 24 THEN 'warn' ELSE 'allow' END WHEN anchor_id = 'a1' AND source = 'sheet' OR anchor_id = 'a3' AND source = 'web' THEN 'warn'
        WHEN anchor_id = 'a2' THEN 'block' ELSE 'warn' END AS decision FROM x)"""


@query("M01_adjudication", f"WITH {_ADJ} SELECT request_id, decision, anchor_id FROM adj")
def adjudication(t):
    return G.adjudicate(_requests(t), _anchors(t), now())


@query("E18_scope_match", f"WITH {_ADJ} SELECT anchor_id, count(*) AS n FROM adj GROUP BY 1")
def scope_match(t):
    return G.matching_anchors(_requests(t), _anchors(t)).groupBy("anchor_id").agg(F.count("*").alias("n"))


_POL = "SELECT event_id AS request_id, event_id % 50 > 0 AS found, CASE event_id % 6 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'odd' ELSE 'active' END AS evidence_status, event_id % 7 = 0 AS w, CASE WHEN event_id % 3 = 0 THEN 'evidence_annotation' ELSE 'evidence_card' END AS kind, CASE WHEN event_id % 9 = 0 THEN 'needs_review' ELSE 'accepted' END AS resolution_status, event_id % 13 AS n_entities, event_id % 5 = 0 AS k FROM events"


@query(
    "M02_policy",
    f"""WITH {_ADJ}, p AS ({_POL}), s AS (SELECT p.request_id, greatest(CASE WHEN NOT found THEN 3 ELSE 0 END, CASE WHEN found AND evidence_status <> 'active' THEN 1 ELSE 0 END, CASE WHEN found AND w THEN 1 ELSE 0 END,
        CASE WHEN found AND kind = 'evidence_annotation' AND (resolution_status <> 'accepted' OR n_entities = 0) THEN 2 ELSE 0 END, CASE decision WHEN 'block' THEN 3 WHEN 'allow' THEN 0 ELSE 1 END, CASE WHEN k THEN 1 ELSE 0 END) AS lv FROM p JOIN adj USING (request_id))
    SELECT request_id, ['allow', 'warn', 'require_review', 'block'][lv + 1] AS policy FROM s""",
)
def policy(t):
    p = t.spark.sql(_POL.replace("FROM events", "FROM {events}"), events=t.events).withColumns({"n_warnings": F.col("w").cast("int"), "n_conflicts": F.col("k").cast("int")})
    a = G.adjudicate(_requests(t), _anchors(t), now()).select("request_id", F.col("decision").alias("authority"))
    return G.policy(p.join(a, "request_id"))


@query("E20_evidence_reference", "SELECT 'e' || event_id AS evidence_id, CASE WHEN event_id % 2 = 0 THEN 'evidence_card' WHEN event_id % 3 = 0 THEN 'graph_evidence' WHEN event_id % 5 = 0 THEN 'evidence_annotation' ELSE 'missing' END AS store, CASE WHEN event_id % 2 = 0 THEN 'fresh' WHEN event_id % 3 = 0 THEN 'active' WHEN event_id % 5 = 0 THEN 'accepted' ELSE 'missing' END AS status FROM events")
def reference(t):
    ids = t.events.select("event_id", F.concat(F.lit("e"), "event_id").alias("id"))
    store = lambda n, s: ids.where(F.col("event_id") % n == 0).select("id", F.lit(s).alias("status"))
    return G.evidence_reference(ids.select(F.col("id").alias("evidence_id")), store(2, "fresh"), store(3, "active"), store(5, "accepted"))


@query(
    "G06_hash_chain",
    """SELECT user_id, count(*) AS links, CAST(0 AS BIGINT) AS payload_errors, count(*) FILTER (event_id % 100 = 17) AS previous_errors, count(*) FILTER (event_id % 100 = 17) AS receipt_errors FROM events GROUP BY 1""",
)
def chain(t):
    """The events of each user as a chain; every hundredth link is damaged and must be found."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    base = t.events.withColumns({"seq": F.row_number().over(w), "payload": F.col("props"), "actor": F.lit("user")}).withColumn("payload_hash", F.sha2("payload", 256))
    # receipts refer to what came before, so a test chain takes each event's own position as its previous hash
    mark = F.sha2(F.concat_ws("/", "user_id", "seq"), 256)
    before = F.when(F.col("seq") == 1, F.lit("")).otherwise(F.sha2(F.concat_ws("/", "user_id", F.col("seq") - 1), 256))
    rows = base.select("user_id", "seq", "event_id", "event_type", "actor", "payload", "payload_hash", before.alias("previous_hash"), mark.alias("receipt_hash"))
    damaged = rows.withColumn("previous_hash", F.when(F.col("event_id") % 100 == 17, F.lit("bad")).otherwise(F.col("previous_hash")))
    found = G.verify_chain(damaged, ["user_id"])
    bad = damaged.select("user_id", "seq", (F.col("previous_hash") == "bad").alias("bad"))
    return found.join(bad, ["user_id", "seq"]).groupBy("user_id").agg(
        F.count("*").alias("links"), F.count_if("payload_mismatch").alias("payload_errors"), F.count_if("previous_mismatch").alias("previous_errors"), F.count_if("bad").alias("receipt_errors")
    )


@query("M04_governance_checks", f"WITH {ctes('conflicts', 'sources')} SELECT 'conflicts' AS check_name, CASE WHEN e > 0 THEN 'error' WHEN w > 0 THEN 'warn' ELSE 'ok' END AS result, e AS errors, w AS warnings FROM (SELECT count(*) FILTER (severity = 'high' AND status = 'open') AS e, count(*) FILTER (status = 'open') AS w FROM conflicts) UNION ALL SELECT 'sources', CASE WHEN e > 0 THEN 'error' WHEN w > 0 THEN 'warn' ELSE 'ok' END, e, w FROM (SELECT count(*) FILTER (id IS NULL) AS e, count(*) FILTER (last_checked_at IS NULL) AS w FROM sources)")
def checks(t):
    c = F.col
    return G.checks(
        ("conflicts", view(t, "conflicts"), (c("severity") == "high") & (c("status") == "open"), c("status") == "open"),
        ("sources", view(t, "sources"), c("id").isNull(), c("last_checked_at").isNull()),
    )
