"""Queries of sources, converters, chunking and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import vectors as V
from ..sources import converters as X
from ..sources import media as M
from ..sources import units as U
from .registry import query
from .text_queries import UNIX, strip

_EXT = "CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.EXTENSIONS.items()) + f" ELSE '{M.UNKNOWN}' END"
_REFS = """SELECT p_partkey, 'https://x.org/' || lower(replace(p_brand, '#', '.')) || '/file' || p_partkey || '.' || CASE p_partkey % 8 WHEN 0 THEN 'MD' WHEN 1 THEN 'html' WHEN 2 THEN 'csv' WHEN 3 THEN 'docx' WHEN 4 THEN 'png' WHEN 5 THEN 'mp3'
    WHEN 6 THEN 'json' ELSE 'zzz' END || '?v=1' AS ref, CASE p_partkey % 5 WHEN 0 THEN 'Application/X-PDF; q=1' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'text/x-markdown' ELSE '' END AS ct FROM part"""
_FAMILY = f"""CASE WHEN mt LIKE 'text/%' THEN 'text' WHEN mt LIKE 'image/%' THEN 'image' WHEN mt LIKE 'audio/%' THEN 'audio' WHEN mt LIKE 'video/%' THEN 'video' WHEN mt IN ('application/json', 'application/jsonl') THEN 'structured'
    WHEN mt IN ('application/pdf', '{M.EXTENSIONS["docx"]}', '{M.EXTENSIONS["pptx"]}', '{M.EXTENSIONS["xlsx"]}') THEN 'document' ELSE 'unknown' END"""
_TYPED = f"r AS ({_REFS}), u AS (SELECT *, regexp_replace(regexp_replace(ref, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS path FROM r), m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'application/pdf' WHEN 2 THEN 'text/markdown' ELSE {_EXT} END AS mt FROM u)"


def _refs(t):
    return t.spark.sql(_REFS.replace("FROM part", "FROM {part}"), part=t.part)


@query("A01_media_type", f"WITH {_TYPED} SELECT p_partkey, mt AS media_type FROM m")
def media_types(t):
    return _refs(t).select("p_partkey", M.detect_media_type(F.col("ref"), F.col("ct")).alias("media_type"))


@query("A02_media_family", f"WITH {_TYPED} SELECT p_partkey, {_FAMILY} AS family FROM m")
def families(t):
    rows = _refs(t).select("p_partkey", M.detect_media_type(F.col("ref"), F.col("ct")).alias("media_type"))
    return rows.select("p_partkey", M.media_family(F.col("media_type")).alias("family"))


@query(
    "A20_inspection",
    f"""WITH {_TYPED}, c AS (SELECT mt, CASE mt WHEN 'text/html' THEN 'html' WHEN 'text/csv' THEN 'csv' WHEN 'application/json' THEN 'json' WHEN 'application/pdf' THEN 'pdf' WHEN '{M.EXTENSIONS["docx"]}' THEN 'docx'
        ELSE CASE {_FAMILY} WHEN 'text' THEN 'text' WHEN 'image' THEN 'image' WHEN 'audio' THEN 'audio' WHEN 'video' THEN 'video' END END AS converter FROM m)
    SELECT mt AS media_type, converter, CASE WHEN converter IS NULL THEN 'unsupported' ELSE 'ready' END AS status, count(*) AS n FROM c GROUP BY ALL""",
)
def inspection(t):
    mt = M.detect_media_type(F.col("ref"), F.col("ct"))
    rows = _refs(t).select(mt.alias("media_type")).withColumn("converter", M.converter(F.col("media_type")))
    status = F.when(F.col("converter").isNull(), "unsupported").otherwise("ready")
    return rows.groupBy("media_type", "converter", status.alias("status")).agg(F.count("*").alias("n"))


@query("A05_html_text")
def html_exact(t):
    """Text of every page by the exact parser, through the same conversion as files; SQL can't express the parser."""
    files = t.pages.select(F.col("page_id").cast("string").alias("path"), F.encode("html", "utf-8").alias("content"), F.lit("text/html").alias("media_type"))
    units = X.convert(files).where("unit_type = 'page'")
    return units.select(F.col("source_ref").cast("long").alias("page_id"), F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars"))


@query(
    "A05_html_text_regex",
    rf"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<svg\b.*?</svg\s*>', ' ', 'g') AS x FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(p|br|li|h[1-4]|tr)\b[^>]*>', chr(10), 'g') AS x FROM a),
    c AS (SELECT page_id, regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \t]+', ' ', 'g') AS x FROM b),
    d AS (SELECT page_id, regexp_replace(regexp_replace(x, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM c)
    SELECT page_id, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') AS text FROM d""",
)
def html_regex(t):
    return t.pages.select("page_id", X.html_text(F.col("html")).alias("text"))


@query("A28_links", r"""WITH k AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="(https?://[^"]+)"[^>]*>(.*?)</a>')) AS m FROM pages) SELECT page_id, regexp_extract(m, 'href="(https?://[^"]+)"', 1) AS url FROM k""")
def links(t):
    return t.pages.select("page_id", F.explode(X.links(F.col("html"))).alias("l")).select("page_id", "l.url")


_VTT = """SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(lpad(CAST(floor(turn * 75 / 3600) AS INT)::VARCHAR, 2, '0') || ':' || lpad(CAST(floor(turn * 75 / 60) % 60 AS INT)::VARCHAR, 2, '0') || ':' || lpad((turn * 75 % 60)::VARCHAR, 2, '0')
    || '.000 --> ' || lpad(CAST(floor((turn * 75 + 60) / 3600) AS INT)::VARCHAR, 2, '0') || ':' || lpad(CAST(floor((turn * 75 + 60) / 60) % 60 AS INT)::VARCHAR, 2, '0') || ':' || lpad(((turn * 75 + 60) % 60)::VARCHAR, 2, '0') || '.000' || chr(10) || trim(text),
    chr(10) || chr(10) ORDER BY turn) AS vtt FROM conversations WHERE trim(text) <> '' GROUP BY conv_id"""


def _segments(t):
    return t.conversations.select("conv_id", (F.col("turn") * 75.0).alias("start"), (F.col("turn") * 75.0 + 60).alias("end"), "text", "turn", "role")


@query("A15_segments_to_vtt", _VTT)
def vtt(t):
    return X.to_vtt(_segments(t), "conv_id")


@query("A14_transcript_cues", """SELECT conv_id, turn * 75.0 AS "start", turn * 75.0 + 60 AS "end", trim(regexp_replace(trim(text), '\\s*\\n\\s*', ' ', 'g')) AS text FROM conversations WHERE trim(text) <> ''""")
def cues(t):
    flat = _segments(t).withColumn("text", F.regexp_replace("text", r"\n\s*\n", "\n"))  # a blank line would end a cue
    rows = X.to_vtt(flat, "conv_id").select("conv_id", F.explode(X.cues(F.col("vtt"))).alias("c"))
    return rows.select("conv_id", "c.start", "c.end", "c.text")


@query(
    "D22_speakers",
    """WITH s AS (SELECT conv_id, turn AS segment, turn * 75.0 AS a, turn * 75.0 + 60 AS b FROM conversations), r AS (SELECT conv_id, role AS speaker, turn * 75.0 - 20 AS a, turn * 75.0 + 25 AS b FROM conversations),
    h AS (SELECT s.conv_id, s.segment, r.speaker, row_number() OVER (PARTITION BY s.conv_id, s.segment ORDER BY least(s.b, r.b) - greatest(s.a, r.a) DESC, r.a, r.speaker) AS rn FROM s JOIN r ON r.conv_id = s.conv_id AND least(s.b, r.b) > greatest(s.a, r.a))
    SELECT s.conv_id, s.segment, coalesce(h.speaker, '') AS speaker FROM s LEFT JOIN h ON h.conv_id = s.conv_id AND h.segment = s.segment AND h.rn = 1""",
)
def speaker_of(t):
    turns = _segments(t).select("conv_id", (F.col("start") - 20).alias("start"), (F.col("start") + 25).alias("end"), F.col("role").alias("speaker"))
    return X.speakers(_segments(t).select("conv_id", F.col("turn").alias("segment"), "start", "end"), turns, "conv_id")


@query("D21_words_in_segments", "SELECT conv_id, turn AS segment, string_agg('w' || k, ' ' ORDER BY k) AS words FROM conversations, range(0, 60, 10) r(k) WHERE k + 9 <= 60 GROUP BY 1, 2")
def words_in(t):
    seg = _segments(t).select("conv_id", F.col("turn").alias("segment"), "start", "end")
    words = seg.select("conv_id", F.col("start").alias("base"), F.explode(F.sequence(F.lit(0), F.lit(50), F.lit(10))).alias("k")).select(
        "conv_id", (F.col("base") + F.col("k")).alias("start"), (F.col("base") + F.col("k") + 9).alias("end"), F.concat(F.lit("w"), "k").alias("word")
    )
    return X.words_in_segments(words, seg, "conv_id")


@query("A25_unit_counts", "SELECT 'conv:' || conv_id AS source_ref, role AS unit_type, count(*) AS n FROM conversations GROUP BY 1, 2")
def unit_counts(t):
    units = t.conversations.select(F.concat(F.lit("conv:"), "conv_id").alias("source_ref"), F.col("role").alias("unit_type"))
    return U.unit_counts(units)


@query("A25_assembled_text", "SELECT 'conv:' || conv_id AS source_ref, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def assembled(t):
    return U.assembled_text(t.conversations.select(F.concat(F.lit("conv:"), "conv_id").alias("source_ref"), F.col("turn").alias("unit_index"), "text"))


@query(
    "A23_parse_quality",
    """WITH k AS (SELECT conv_id, sum(length(text)) AS c, count(*) AS u, count(*) FILTER (role = 'user') AS s, count(*) FILTER (length(text) < 40) AS e, conv_id % 3 AS w FROM conversations GROUP BY conv_id)
    SELECT conv_id, round(CASE WHEN c = 0 THEN 0 ELSE greatest(0, least(1, 0.35 + least(0.35, c / 6000) + least(0.12, u / 80) + least(0.12, s / 40) - least(0.2, e / greatest(u, 1) * 0.2) - least(0.25, w * 0.05))) END, 6) AS quality FROM k""",
)
def quality(t):
    k = t.conversations.groupBy("conv_id").agg(
        F.sum(F.length("text")).alias("c"), F.count("*").alias("u"), F.count_if(F.col("role") == "user").alias("s"), F.count_if(F.length("text") < 40).alias("e")
    )
    c = F.col
    return k.select("conv_id", F.round(U.parse_quality(c("c"), c("u"), c("s"), c("e"), c("conv_id") % 3, F.lit(False), F.lit(0)), 6).alias("quality"))


@query("D01_chunk_strategy", r"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'json' WHEN 2 THEN 'markdown' ELSE CASE WHEN doc_id % 5 = 3 THEN 'markdown' WHEN regexp_matches(text, '(?m)^#{1,6}\s+\S') OR contains(text, '```') THEN 'markdown' ELSE 'plain' END END AS strategy FROM documents")
def strategies(t):
    path = F.element_at(F.array(*map(F.lit, ["/a/x.PY", "/a/x.json", "/a/x.md", "/a/x", "/a/x"])), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 5 == 3, "docs").otherwise("web")
    return t.documents.select("doc_id", C.strategy(F.col("text"), path, kind).alias("strategy"))


@query(
    "D04_plain_blocks",
    rf"""WITH k AS (SELECT conv_id, string_agg(text, chr(10) || ' ' || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    n AS (SELECT conv_id, {strip(rf"regexp_replace({UNIX.format('text')}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")} AS x FROM k),
    b AS (SELECT conv_id, list_filter(list_transform(string_split_regex(x, '\n\s*\n'), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM n)
    SELECT conv_id, len(ps) AS n_blocks, array_to_string(ps, '|') AS blocks FROM b""",
)
def plain_blocks(t):
    from pyspark.sql import functions as F  # noqa: PLC0415

    k = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    ps = C.plain_paragraphs(F.array_join("ts.text", "\n \n"))
    return k.select("conv_id", F.size(ps).cast("long").alias("n_blocks"), F.array_join(ps, "|").alias("blocks"))


@query("D07_sentences", r"""SELECT doc_id, len(regexp_extract_all(text, '[.!?]\s+\S')) + 1 AS n_sentences FROM documents WHERE regexp_matches(text, '\S$')""")
def sentences(t):
    rows = t.documents.where(F.col("text").rlike(r"\S\z"))
    return rows.select("doc_id", F.size(C.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def _chunks(t):
    strategy = C.strategy(F.col("text"), F.lit(""), F.when(F.col("lang") == "en", "docs").otherwise("web"))
    return C.chunk_rows(t.documents.select("doc_id", "text", strategy.alias("strategy")))


@query("D08_chunks")
def chunks(t):
    """Packed chunks of every document; packing carries state along a text, which SQL can't express (tests hold it against a plain version)."""
    return _chunks(t).select("doc_id", "chunk_index", "strategy", "section", F.array_join("block_types", ",").alias("block_types"), "text_hash", "token_estimate")


@query("D08_chunk_coverage", "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS n_visible FROM documents WHERE regexp_matches(text, '\\S')")
def coverage(t):
    """Packing loses and repeats nothing: the chunks of a document hold all its visible characters once."""
    return _chunks(t).groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"(?U)\s", ""))).alias("n_visible"))


@query("D10_chunk_rows")
def chunk_rows(t):
    return _chunks(t).select("doc_id", "chunk_id", F.length("previous_context").alias("tail"), "token_estimate")


@query("D15_hash_embedding")
def hash_embedding(t):
    """384 places for each document by BLAKE2b, which neither engine's SQL has; tests hold it against a plain version."""
    rows = V.embed(t.documents, "doc_id", "text")
    return rows.select("doc_id", "vector_hash", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("square"))


@query(
    "D15_hashed_features",
    f"""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.TOKEN}')) AS word FROM documents),
    h AS (SELECT doc_id, CAST('0x' || substr(sha256(word), 1, 8) AS BIGINT) % 384 AS place, CASE WHEN CAST('0x' || substr(sha256(word), 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM k)
    SELECT doc_id, place, CAST(sum(s) AS BIGINT) AS weight FROM h GROUP BY 1, 2 HAVING sum(s) <> 0""",
)
def hashed(t):
    return V.hashed_features(t.documents, "doc_id", "text")


@query("D19_pending_embeddings", "SELECT doc_id, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS tokens FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending(t):
    return V.pending(t.documents, t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "C29_metric_coercion",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) WHEN event_id % 4 = 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE CAST(round(value, 4) AS VARCHAR) END AS metric FROM events",
)
def coercion(t):
    raw = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(F.col("event_id") % 4 == 1, F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", T.metric_number(raw).alias("metric"))
