"""The registered queries opN_<name> of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bpe import encode_decode
from .byte_level import round_trip
from .common import scratch, tokenizer_file
from .exact_dedup import exact_groups
from .hard_negatives import hard_negatives
from .minhash import near_duplicates
from .mixing import mix
from .pii import KINDS, find_pii
from .prefix_trie import prefix_trie
from .spotsigs import edit_and_compare
from .token_count import count_tokens, unigram_vocabulary
from .token_store import materialise, read_sequences
from .toxicity import score_toxicity
from .warc import read_records, write_archives


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_and_compare(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), unigram_vocabulary(tokenizer_file("piece_bpe_32k.model")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    return read_sequences(materialise(table(spark, sf_dir, "documents"), out, tokenizer_file("byte_bpe_50k.tiktoken")), out)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), out)
    return read_records(index, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts are those of base spans, like its hash; what the field adds stands in ``spans`` and in the counts of all spans."""
    found = find_pii(table(spark, sf_dir, "documents"))
    of = lambda what, name: [F.col(f"{what}_{k}").alias(f"{name}_{k}") for k in KINDS]
    return found.select("doc_id", *of("base", "n"), "base_sha256", "spans", "n_added", *of("n", "all"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), branch=True)


def op12_byte_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_spotsigs,
        op3_token_counts,
        op4_mix_sources,
        op5_token_store,
        op6_minhash,
        op7_warc,
        op8_bpe,
        op9_pii,
        op10_toxicity,
        op11_prefix_trie,
        op12_byte_level,
        op13_hard_negatives,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(body) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
    """,
    "op6_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                   ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
            FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
        k AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
        SELECT k.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, k.id = component_id AS kept FROM k LEFT JOIN n ON n.doc_id = k.id
    """,
    "op7_warc": r"""
        WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT html, min(page_id) AS first FROM d GROUP BY html)
        SELECT page_id, CAST(strlen(d.html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(floor(i / 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d JOIN f ON f.html = d.html
    """,
    "op11_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i, key, words
            FROM (SELECT conv_id, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS key,
                         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
                  FROM conversations WHERE conv_id IS NOT NULL)
        ),
        c AS (  -- the CRC-32 of the id's digits, bit by bit
            SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                       lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
            FROM own GROUP BY conv_id
        ),
        t AS (
            SELECT c.conv_id, i, key, words FROM c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 20 AND i <= h
            UNION ALL
            SELECT c.conv_id, i + coalesce(least(h, (SELECT count(*) FROM own o WHERE o.conv_id = c.conv_id - c.conv_id % 20)), 0) - h, key, words
            FROM c JOIN own ON own.conv_id = c.conv_id AND i > h
        ),
        p AS (
            SELECT conv_id, i AS depth, words, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY i) AS path FROM t
            UNION ALL SELECT conv_id, 0, 0, '' FROM c
        ),
        n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM p GROUP BY path, depth),
        k AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
              FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path),
        s AS (
            SELECT left(path, 32 * d) AS path, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
            FROM (SELECT n.path, saved, CASE WHEN k.path IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, depth + 1)) AS d FROM n LEFT JOIN k ON k.path = n.path)
            GROUP BY 1
        )
        SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
               coalesce(e.ends, sha256('')) AS ends_sha256
        FROM n JOIN s ON s.path = n.path
        LEFT JOIN n up ON n.depth > 0 AND up.path = left(n.path, length(n.path) - 32)
        LEFT JOIN k ON k.path = n.path
        LEFT JOIN e ON e.path = n.path
    """,
    "op13_hard_negatives": r"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ),
        p AS (SELECT anchor_id, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other)
        QUALIFY row_number() OVER w <= 3
    """,
}
