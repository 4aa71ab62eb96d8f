"""Queries of retrieval, fusion and priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import text_index as I
from ..operators import vector_index as C
from ..shared import scratch
from ..sources.store import Store
from .registry import query
from .standins import ctes, view

NOW = "TIMESTAMP '2024-02-10 12:00:00'"


def now():
    return F.lit("2024-02-10 12:00:00").cast("timestamp")


def lookup_sql(x: str, table: dict[str, float], default: float) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in table.items()) + f" ELSE {default} END"


CONF = lookup_sql("lower(trim(coalesce(c.confidence, '')))", T.CONFIDENCE_SCORES, 0.5)
STAT = lookup_sql("lower(trim(coalesce({}, '')))", T.STATUS_SCORES, 0.55)
FRESH = f"""CASE WHEN last_checked_at IS NULL THEN 0.55
    WHEN greatest(epoch_us({NOW}) - epoch_us(last_checked_at), 0) / 86400e6 <= greatest(freshness_window_days, 1) THEN 1.0
    WHEN greatest(epoch_us({NOW}) - epoch_us(last_checked_at), 0) / 86400e6 <= 2 * greatest(freshness_window_days, 1) THEN 0.65 ELSE 0.25 END"""


def bm25_sql(n_terms: int = 12, queries: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""
    bq AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '{T.TOKEN}')[1:{n_terms}])) AS term FROM ({queries})),
    bt AS (SELECT doc_id, regexp_extract_all(lower(text), '{T.TOKEN}') AS tokens FROM documents),
    bs AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM bt),
    bx AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM bt),
    bf AS (SELECT term, doc_id, dl, count(*) AS tf FROM bx WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
    bd AS (SELECT term, count(*) AS df FROM bf GROUP BY term),
    bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
           FROM bq JOIN bf USING (term) JOIN bd USING (term) CROSS JOIN bs GROUP BY query_id, doc_id)"""


@query(
    "J02_bm25",
    f"""WITH {bm25_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)
    SELECT query_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
)
def bm25(t):
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    hits = R.top_k(R.bm25(t.documents, q, "doc_id", "text"), 10)
    return hits.select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def _stored(t, docs):
    """A fresh store that holds documents as chunks of their own."""
    store = Store(t.spark, scratch(t.spark, "index"), 16)
    I.update(store, docs, I.as_they_are)
    return store


@query(
    "J02_indexed_search",
    f"""WITH {bm25_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)
    SELECT query_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
)
def indexed(t):
    """The search of J02_bm25 from stored posting blocks; no text is read once the index is there."""
    none = F.lit("")
    store = _stored(t, t.documents.select("doc_id", none.alias("title"), none.alias("section"), "text"))
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return I.search(store, q, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(
    "J02_weighted_fields",
    f"""WITH bq AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '{T.TOKEN}')[1:12])) AS term FROM benchmark),
    bt AS (SELECT doc_id, regexp_extract_all(lower('Document ' || lang || ' ' || source), '{T.TOKEN}') AS a, regexp_extract_all(lower(regexp_extract(text, '^[^.]*')), '{T.TOKEN}') AS b, regexp_extract_all(lower(text), '{T.TOKEN}') AS c FROM documents),
    bs AS (SELECT count(*) AS n, avg(len(a) + len(b) + len(c)) AS avgdl FROM bt),
    bx AS (SELECT doc_id, len(a) + len(b) + len(c) AS dl, unnest(a || b || c) AS term, unnest(list_transform(a, lambda x: 3.0) || list_transform(b, lambda x: 2.0) || list_transform(c, lambda x: 1.0)) AS w FROM bt),
    bf AS (SELECT term, doc_id, dl, sum(w) AS tf FROM bx WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
    bd AS (SELECT term, count(*) AS df FROM bf GROUP BY term),
    bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM bq JOIN bf USING (term) JOIN bd USING (term) CROSS JOIN bs GROUP BY query_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)
    SELECT query_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
)
def weighted_fields(t):
    """Title, section and text count 3, 2 and 1; the section is a document's first sentence."""
    title = F.concat(F.lit("Document "), "lang", F.lit(" "), "source")
    store = _stored(t, t.documents.select("doc_id", title.alias("title"), F.regexp_extract("text", "^[^.]*", 0).alias("section"), "text"))
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    hits = I.search(store, q, 10, {"title": 3.0, "section": 2.0})
    return hits.select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


#: A later state of the documents: every ninth text has grown, every eleventh document is gone, every thirteenth of the rest comes twice under a new id.
_LATER = """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || ' changed' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0
    UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 13 = 0 AND doc_id % 11 <> 0"""


def _later(t):
    docs = t.documents.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    return docs.unionByName(t.documents.where("doc_id % 13 = 0 AND doc_id % 11 <> 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), "text"))


def _fields(docs):
    return docs.select("doc_id", F.lit("").alias("title"), F.lit("").alias("section"), "text")


@query(
    "L09_index_run",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 9 = 0 AND text IS NOT NULL THEN 'changed' ELSE 'unchanged' END AS state FROM documents
    UNION ALL SELECT doc_id + 1000000000, 'new' FROM documents WHERE doc_id % 13 = 0 AND doc_id % 11 <> 0""",
)
def index_run(t):
    """What a second run over a later state of the documents finds: only what is new or changed is chunked and written."""
    store = _stored(t, _fields(t.documents))
    return I.update(store, _fields(_later(t)), I.as_they_are)


@query("L16_stored_chunks", f"SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM ({_LATER})")
def stored_chunks(t):
    """The chunks that are stored after the second run."""
    store = _stored(t, _fields(t.documents))
    I.update(store, _fields(_later(t)), I.as_they_are)
    return store.read("chunks").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


@query(
    "L09_updated_search",
    f"""WITH {bm25_sql().replace("FROM documents", f"FROM ({_LATER})")}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)
    SELECT query_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""",
)
def updated_search(t):
    """A search after the second run, over blocks of which those of untouched buckets are the first run's."""
    store = _stored(t, _fields(t.documents))
    I.update(store, _fields(_later(t)), I.as_they_are)
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return I.search(store, q, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(
    "G01_reciprocal_rank",
    f"""WITH {bm25_sql()} SELECT query_id, doc_id, round(1.0 / row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id), 9) AS rr FROM bm""",
)
def reciprocal(t):
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return R.reciprocal_rank(R.bm25(t.documents, q, "doc_id", "text")).select("query_id", "doc_id", F.round("rr", 9).alias("rr"))


@query(
    "J11_retrieval_eval",
    f"""WITH {bm25_sql(100000)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm),
    o AS (SELECT query_id, lower(string_agg(d.text, ' ')) AS out FROM r JOIN documents d USING (doc_id) WHERE rank <= 8 GROUP BY query_id),
    e AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{T.TOKEN}')) AS expect FROM benchmark)
    SELECT item_id AS case_id, len(list_filter(expect, lambda w: NOT contains(coalesce(out, ''), w))) = 0 AS passed FROM e LEFT JOIN o ON o.query_id = e.item_id""",
)
def retrieval_eval(t):
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    hits = R.top_k(R.bm25(t.documents, q, "doc_id", "text", 100_000), 8)
    shown = hits.join(t.documents.select("doc_id", "text"), "doc_id").select(F.col("query_id").alias("case_id"), "text")
    cases = t.benchmark.select(F.col("item_id").alias("case_id"), F.array_distinct(T.tokenize(F.col("text"))).alias("expect"))
    return R.all_terms_present(shown, cases)


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(
    "D17_vector_math",
    """SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
       round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first_unit,
       len(embedding) AS dims FROM embeddings""",
)
def vector_math(t):
    v = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.round(R.norm(v), 6).alias("norm"), F.round(R.normalize_vector(v)[0], 6).alias("first_unit"), F.size(v).cast("long").alias("dims")
    )


#: Searches take every item and vector whose number is divisible by this as a query, against all rows.
EVERY = 50
_ITEMS = f"SELECT item_id AS query_id, text FROM benchmark WHERE item_id % {EVERY} = 0"


def _items(t):
    return t.benchmark.where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), "text")


def _query_vectors(t):
    return t.embeddings.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _near_sql(k: int, where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, {_COS} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COS}, 6) DESC, a.vec_id) AS rn
        FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) b WHERE {where}) WHERE rn <= {k}"""


@query("H01_vector_top_k", f"SELECT query_id, doc_id, round(score, 5) AS score FROM ({_near_sql(40)})")
def vector_top_k(t):
    return R.vector_hits(t.embeddings, _query_vectors(t), 40).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("H01_indexed_top_k", f"SELECT query_id, doc_id, round(score, 5) AS score FROM ({_near_sql(40)})")
def indexed_top_k(t):
    """The search of H01 from stored cells: those whose bound lies below a query's fortieth score are not opened."""
    return C.nearest(C.build_index(t.embeddings), _query_vectors(t), 40).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query(
    "E01_vector_chunk_source",
    f"""WITH {ctes('chunks', 'sources')}, h AS ({_near_sql(8, "a.vec_id IN (SELECT chunk_id FROM chunks c JOIN sources s ON s.id = c.source_id WHERE c.status = 'active')")})
    SELECT query_id, doc_id AS chunk_id, c.title, s.title AS source_title, round(score, 5) AS score FROM h JOIN chunks c ON c.chunk_id = doc_id JOIN sources s ON s.id = c.source_id""",
)
def vector_join(t):
    # the filter and the join come first: the limit counts visible rows only
    rows = R.with_sources(t.embeddings.withColumnRenamed("vec_id", "chunk_id"), view(t, "chunks"), view(t, "sources"))
    hits = R.vector_hits(rows, _query_vectors(t), 8, "chunk_id").withColumnRenamed("doc_id", "chunk_id")
    shown = R.with_sources(hits, view(t, "chunks"), view(t, "sources"))
    return shown.select("query_id", "chunk_id", "title", "source_title", F.round("score", 5).alias("score"))


@query(
    "J01_semantic_search",
    f"""WITH {bm25_sql(12, _ITEMS)}, v AS ({_near_sql(8)}),
    k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rn FROM bm),
    u AS (SELECT query_id, 'vector' AS mode, doc_id, score FROM v UNION ALL SELECT query_id, 'keyword', doc_id, 1.0 / rn FROM k WHERE rn <= 8),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, mode, doc_id) AS rn FROM u)
    SELECT query_id, mode, doc_id, round(score, 5) AS score FROM r WHERE rn <= 8""",
)
def semantic_search(t):
    keyword = R.reciprocal_rank(R.top_k(R.bm25(t.documents, _items(t), "doc_id", "text"), 8)).select("query_id", "doc_id", F.col("rr").alias("score"))
    both = R.merged_modes(8, vector=R.vector_hits(t.embeddings, _query_vectors(t), 8), keyword=keyword)
    return both.select("query_id", "mode", "doc_id", F.round("score", 5).alias("score"))


_HINTS = f"SELECT DISTINCT query_id, 'tok:' || term AS node_id, term AS name FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{T.TOKEN}')[1:8]) AS term FROM ({_ITEMS}))"
_GRAPH = f"""gl AS (SELECT chunk_id, lower(title || ' ' || ' ' || text) AS low FROM chunks), gh AS ({_HINTS}),
    gs AS (SELECT query_id, chunk_id, least(sum(CASE WHEN contains(low, name) THEN 0.6 ELSE 0.0 END), 2.0) / 2.0 AS graph FROM gl, gh GROUP BY query_id, chunk_id)"""
_HYBRID = f"""{ctes('chunks', 'sources', 'conflicts')}, {bm25_sql(12, _ITEMS)}, {_GRAPH},
    hv AS (SELECT query_id, doc_id AS chunk_id, score FROM ({_near_sql(40)})),
    hk AS (SELECT query_id, doc_id AS chunk_id, 1.0 / rn AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rn FROM bm) WHERE rn <= 40),
    hm AS (SELECT query_id, max(score) AS top FROM hv GROUP BY 1), km AS (SELECT query_id, max(score) AS top FROM hk GROUP BY 1),
    hu AS (SELECT query_id, chunk_id, score / top AS vector, 0.0 AS keyword FROM hv JOIN hm USING (query_id) UNION ALL SELECT query_id, chunk_id, 0.0, score / top FROM hk JOIN km USING (query_id)),
    hf AS (SELECT query_id, chunk_id, max(vector) AS vector, max(keyword) AS keyword FROM hu GROUP BY 1, 2),
    hr AS (SELECT query_id, chunk_id, vector, keyword, coalesce(graph, 0) AS graph, 0.45 * vector + 0.45 * keyword + 0.1 * coalesce(graph, 0) AS relevance FROM hf LEFT JOIN gs USING (query_id, chunk_id))"""


def _hints(t):
    names = _items(t).select("query_id", F.explode(T.fts_terms(F.col("text"), 8)).alias("name")).distinct()
    return names.withColumns({"node_id": F.concat(F.lit("tok:"), "name"), "score": F.lit(1.0)})


def _hybrid(t):
    """Hits of every query: its 40 best by words and by vector, fused, with graph scores of these hits only."""
    keyword = R.reciprocal_rank(R.top_k(R.bm25(t.documents, _items(t), "doc_id", "text"), 40)).select("query_id", "doc_id", F.col("rr").alias("score"))
    vector = R.vector_hits(t.embeddings, _query_vectors(t), 40)
    met = vector.select("query_id", F.col("doc_id").alias("chunk_id")).union(keyword.select("query_id", "doc_id")).distinct()
    return R.fuse(vector, keyword, R.graph_scores(view(t, "chunks"), _hints(t), pairs=met), by="query_id")


@query("J04_graph_score", f"WITH {ctes('chunks')}, {_GRAPH} SELECT query_id, chunk_id, round(graph, 6) AS graph FROM gs")
def graph_score(t):
    """A score for every chunk and query; chunks that hold none of a query's hints score 0."""
    chunks, hints = view(t, "chunks"), _hints(t)
    return R.scored_everywhere(R.graph_scores(chunks, hints), chunks, hints, "graph").select("query_id", "chunk_id", F.round("graph", 6).alias("graph"))


@query(
    "J05_hybrid_relevance",
    f"WITH {_HYBRID} SELECT query_id, chunk_id, round(vector, 5) AS vector, round(keyword, 5) AS keyword, round(graph, 5) AS graph, round(relevance, 5) AS relevance FROM hr",
)
def hybrid(t):
    return _hybrid(t).select("query_id", "chunk_id", *(F.round(c, 5).alias(c) for c in ("vector", "keyword", "graph", "relevance")))


@query(
    "J06_context_priority",
    f"""WITH {_HYBRID}, p AS (SELECT object_id, least(sum(pen), 0.55) AS penalty, count(*) AS n FROM (
            SELECT object_id, CASE status WHEN 'open' THEN 1.0 ELSE 0.6 END * {lookup_sql('severity', T.SEVERITY_PENALTIES, 0.22)} AS pen
            FROM conflicts WHERE status IN ('open', 'acknowledged')) GROUP BY object_id),
    s AS (SELECT hr.query_id, hr.chunk_id, least(1, relevance) AS relevance, graph, {CONF} * 0.55 + least(1, s.credibility_score / 5) * 0.45 AS trust, {FRESH} AS freshness,
            least({STAT.format('c.status')}, {STAT.format('s.status')}) AS status_score, coalesce(penalty, 0) AS penalty
        FROM hr JOIN chunks c USING (chunk_id) LEFT JOIN sources s ON s.id = c.source_id LEFT JOIN p ON p.object_id = hr.chunk_id)
    SELECT query_id, chunk_id, round(trust, 5) AS trust, freshness, round(status_score, 5) AS status_score, round(penalty, 5) AS penalty,
        round(greatest(0, least(1, 0.55 * relevance + 0.15 * trust + 0.1 * freshness + 0.1 * graph + 0.1 * status_score - penalty)), 5) AS priority
    FROM s""",
)
def priority(t):
    rows = R.context_priority(_hybrid(t), view(t, "chunks"), view(t, "sources"), view(t, "conflicts"), now())
    return rows.select("query_id", "chunk_id", F.round("trust", 5).alias("trust"), "freshness", *(F.round(c, 5).alias(c) for c in ("status_score", "penalty", "priority")))


@query("J07_explained_search")
def explained(t):
    """The eight best results of each query with the reasons behind their priority; SQL has no exact equal for the formatted reasons."""
    rows = R.context_priority(_hybrid(t), view(t, "chunks"), view(t, "sources"), view(t, "conflicts"), now())
    best = R.top_k(rows, 8, "query_id", "priority", "chunk_id")
    return best.select("query_id", "rank", "chunk_id", "source_id", F.round("priority", 5).alias("priority"), F.array_join("reasons", "; ").alias("reasons"))


@query(
    "C14_lookup_scores",
    f"""WITH {ctes('chunks', 'sources')} SELECT chunk_id, {CONF} AS confidence_score, {STAT.format('c.status')} AS status_score,
        least(1.0, s.credibility_score / 5) AS credibility FROM chunks c JOIN sources s ON s.id = c.source_id""",
)
def lookup_scores(t):
    c, s = view(t, "chunks"), view(t, "sources").select(F.col("id").alias("source_id"), "credibility_score")
    return c.join(s, "source_id").select(
        "chunk_id",
        T.confidence_score(F.col("confidence")).alias("confidence_score"),
        T.status_score(F.col("status")).alias("status_score"),
        T.credibility_score(F.col("credibility_score").cast("string")).alias("credibility"),
    )


@query("C15_freshness", f"WITH {ctes('sources')} SELECT id, {FRESH} AS freshness FROM sources")
def freshness(t):
    return view(t, "sources").select("id", T.freshness_score(F.col("last_checked_at"), F.col("freshness_window_days"), now()).alias("freshness"))


@query(
    "C16_trust",
    f"""WITH {ctes('chunks', 'sources')} SELECT chunk_id, round(CASE WHEN s.id IS NULL THEN {CONF} ELSE {CONF} * 0.55 + least(1, s.credibility_score / 5) * 0.45 END, 6) AS trust,
        least({STAT.format('c.status')}, CASE WHEN s.id IS NULL THEN 1.0 ELSE {STAT.format('s.status')} END) AS status
        FROM chunks c LEFT JOIN sources s ON s.id = c.source_id AND s.n % 3 > 0""",
)
def trust(t):
    s = view(t, "sources").where("n % 3 > 0").select(F.col("id").alias("source_id"), "credibility_score", F.col("status").alias("source_status"))
    known = F.col("credibility_score").isNotNull()
    return view(t, "chunks").join(s, "source_id", "left").select(
        "chunk_id",
        F.round(T.trust_score(F.col("confidence"), F.col("credibility_score").cast("string"), known), 6).alias("trust"),
        T.combined_status(F.col("status"), F.col("source_status"), known).alias("status"),
    )


@query(
    "C18_conflict_penalty",
    f"""WITH {ctes('conflicts')} SELECT conflict_type, count(*) AS n_conflicts, round(least(sum(CASE status WHEN 'open' THEN 1.0 ELSE 0.6 END
        * {lookup_sql('severity', T.SEVERITY_PENALTIES, 0.22)}), 0.55), 6) AS penalty FROM conflicts WHERE status IN ('open', 'acknowledged') GROUP BY conflict_type""",
)
def penalties(t):
    k = view(t, "conflicts").withColumn("object_id", F.col("conflict_type"))
    return R.conflict_penalties(k).select(F.col("object_id").alias("conflict_type"), "n_conflicts", F.round("penalty", 6).alias("penalty"))


@query(
    "E10_conflicts_of_objects",
    f"""WITH {ctes('conflicts', 'chunks')}, r AS (SELECT DISTINCT c.source_id, k.* FROM chunks c JOIN conflicts k ON k.object_type = 'chunk' AND k.object_id = c.chunk_id WHERE k.status IN ('open', 'acknowledged')),
    w AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, conflict_id DESC) AS rn FROM r)
    SELECT source_id, conflict_id, severity, rn FROM w WHERE rn <= 5""",
)
def conflicts_of(t):
    from ..operators.ledger import open_conflicts_for

    refs = view(t, "chunks").select("source_id", F.lit("chunk").alias("object_type"), F.col("chunk_id").alias("object_id"))
    return open_conflicts_for(refs, view(t, "conflicts"), "source_id", 5).select("source_id", "conflict_id", "severity", "rn")


@query(
    "F18_max_normalized",
    "SELECT event_id, event_type, round(value / CASE WHEN max(value) OVER (PARTITION BY event_type) > 0 THEN max(value) OVER (PARTITION BY event_type) ELSE 1 END, 9) AS score FROM events",
)
def max_normalized(t):
    return R.max_normalized(t.events.select("event_id", "event_type", F.col("value").alias("score")), by="event_type").select("event_id", "event_type", F.round("score", 9).alias("score"))


_RANKING = {"boost_terms": ["green", "steel"], "must_include_any": ["a", "e"], "known_venues": ["brand#1"]}


def _contains_sum(terms) -> str:
    return " + ".join(f"CAST(contains(hay, '{w}') AS INT)" for w in terms)


@query(
    "J12_watchlist_ranking",
    f"""WITH k AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_type) AS hay, p_brand,
            CASE p_partkey % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'semantic_scholar' ELSE 'blog' END AS st, p_size * 4 AS cit, DATE '2024-01-01' - CAST(p_partkey % 500 AS INT) AS pub FROM part),
    s AS (SELECT *, 3.0 * ({_contains_sum(_RANKING['boost_terms'])}) + ({_contains_sum(_RANKING['must_include_any'])}) + 2.0 * ({_contains_sum(_RANKING['known_venues'])})
        + CASE WHEN st <> 'semantic_scholar' THEN 0 WHEN cit >= 100 THEN 3 WHEN cit >= 20 THEN 1.5 ELSE 0 END
        + CASE WHEN DATE '2024-01-01' - pub <= 90 THEN 2 WHEN DATE '2024-01-01' - pub <= 365 THEN 1 ELSE 0 END
        + CASE st WHEN 'arxiv' THEN 1 WHEN 'semantic_scholar' THEN 0.75 ELSE 0.25 END AS score FROM k WHERE {_contains_sum(_RANKING['must_include_any'])} > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rn FROM s)
    SELECT p_brand, p_partkey, CAST(score AS DOUBLE) AS score FROM r WHERE rn = 1""",
)
def watchlist(t):
    hits = t.part.select(
        "p_partkey", "p_brand", F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.col("p_brand").alias("venue"), F.col("p_type").alias("categories"),
        F.when(F.col("p_partkey") % 3 == 0, "arxiv").when(F.col("p_partkey") % 3 == 1, "semantic_scholar").otherwise("blog").alias("source_type"),
        (F.col("p_size") * 4).alias("citations"), F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 500).cast("int")).alias("published"),
    )
    scored = R.watchlist_scores(hits, _RANKING, F.lit("2024-01-01").cast("date"))
    return R.best_per_key(scored, F.col("p_brand"), [F.col("score").desc(), F.col("p_partkey")]).select("p_brand", "p_partkey", "score")
