"""Stand-ins for the engine's own tables, made from the supplied ones by SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Each entry selects from supplied tables or from entries before it, written in braces.
VIEWS = {
    "sources": """
        SELECT DISTINCT 'src:' || source AS id, CAST(substr(source, 4) AS INT) AS n, 'Source ' || CAST(substr(source, 4) AS INT) % 12 AS title,
               'https://WWW.example.org/s' || CAST(floor(CAST(substr(source, 4) AS INT) / 2) AS INT) || '/?utm_source=feed&id=1' AS url,
               CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'docs' WHEN 2 THEN 'web' ELSE 'local' END AS source_type,
               1 + CAST(substr(source, 4) AS INT) % 5 AS credibility_score,
               CASE WHEN CAST(substr(source, 4) AS INT) % 10 = 9 THEN NULL
                    ELSE CAST('2024-01-' || lpad(CAST(1 + CAST(substr(source, 4) AS INT) AS VARCHAR(9)), 2, '0') || ' 00:00:00' AS TIMESTAMP) END AS last_checked_at,
               10 + CAST(substr(source, 4) AS INT) AS freshness_window_days,
               CASE CAST(substr(source, 4) AS INT) % 7 WHEN 0 THEN 'stale_pending_refresh' WHEN 1 THEN 'deprecated' ELSE 'active' END AS status
        FROM {documents}""",
    "chunks": """
        SELECT d.doc_id AS chunk_id, 'src:' || d.source AS source_id, d.text, d.lang, 'Document ' || d.doc_id AS title,
               CASE l.quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS confidence,
               CASE WHEN d.doc_id % 13 = 0 THEN 'provisional' ELSE 'active' END AS status
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "conflicts": """
        SELECT doc_id AS conflict_id, 'chunk' AS object_type, doc_id AS object_id,
               CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
               CASE doc_id % 5 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'resolved' ELSE 'open' END AS status,
               CASE WHEN toxic = 1 THEN 'contradiction' ELSE 'duplicate_content' END AS conflict_type
        FROM {labels} WHERE toxic = 1 OR quality = 0""",
    "nodes": """
        SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS name, 'Region of the world' AS summary, 'active' AS status, 'high' AS confidence FROM {region}
        UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'Nation in region ' || n_regionkey,
               CASE n_nationkey % 10 WHEN 9 THEN 'deprecated' WHEN 8 THEN 'provisional' ELSE 'active' END, 'medium' FROM {nation}
        UNION ALL SELECT 'supplier:' || s_suppkey, 'account', s_name, 'Supplier that should use nation ' || s_nationkey,
               CASE s_suppkey % 10 WHEN 9 THEN 'deprecated' WHEN 8 THEN 'provisional' ELSE 'active' END, 'low' FROM {supplier}
        UNION ALL SELECT 'customer:' || c_custkey, 'account', c_name, 'Customer in segment ' || c_mktsegment,
               CASE c_custkey % 10 WHEN 9 THEN 'merged' WHEN 8 THEN 'provisional' ELSE 'active' END, 'medium' FROM {customer}
        UNION ALL SELECT 'part:' || p_partkey, 'concept', p_name,
               CASE WHEN p_partkey % 2 = 0 THEN 'Use ' ELSE 'Avoid ' END || p_type || ' of brand ' || p_brand,
               CASE p_partkey % 10 WHEN 9 THEN 'deprecated' WHEN 8 THEN 'provisional' ELSE 'active' END, 'medium' FROM {part}""",
    "evidence": """
        SELECT 'ev:' || n_nationkey AS id, CASE n_nationkey % 6 WHEN 5 THEN 'reverted' WHEN 4 THEN 'conflicted' ELSE 'active' END AS status FROM {nation}""",
    "edges": """
        SELECT 'customer:' || c_custkey AS source_id, 'located_in' AS relation, 'nation:' || c_nationkey AS target_id, 'ev:' || c_nationkey AS evidence_id,
               'medium' AS confidence, 'active' AS status FROM {customer}
        UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, 'ev:' || s_nationkey, 'high', 'active' FROM {supplier}
        UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey, CAST(NULL AS VARCHAR(9)), 'high', 'active' FROM {nation}
        UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey, CAST(NULL AS VARCHAR(9)), 'low',
               CASE WHEN (l_suppkey + l_partkey) % 11 = 0 THEN 'deprecated' ELSE 'active' END FROM {lineitem}""",
    "aliases": """
        SELECT 'customer:' || c_custkey AS node_id, 'The ' || c_name || ' Inc' AS alias FROM {customer}
        UNION ALL SELECT 'supplier:' || s_suppkey, s_name || ' Ltd' FROM {supplier}
        UNION ALL SELECT 'part:' || p_partkey, p_brand FROM {part}""",
    "tags": """
        SELECT 'part:' || p_partkey AS node_id, p_type AS tag FROM {part}
        UNION ALL SELECT 'customer:' || c_custkey, c_mktsegment FROM {customer}""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


def view(t, name: str) -> DataFrame:
    """A stand-in as a DataFrame over the tables ``t``."""
    if name not in VIEWS:
        return getattr(t, name)
    return t.spark.sql(VIEWS[name], **{n: view(t, n) for n in _needs(name)})


def ctes(*names: str) -> str:
    """``name AS (...)`` for stand-ins, with what they need, to follow WITH."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in done:
            for n in _needs(name):
                add(n)
            done[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])

    for name in names:
        add(name)
    return ", ".join(f"{n} AS ({sql})" for n, sql in done.items())
