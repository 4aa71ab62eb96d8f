"""Queries of the scalar text functions, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query

STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x0b\x85\p{{Z}}]+', ''), '[\s\x0b\x85\p{{Z}}]+$', '')"
UNIX = r"replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
NORM = r"trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"


def strip(x: str) -> str:
    return STRIP.format(x)


def norm(x: str) -> str:
    return NORM.format(x)


def words(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def listed(xs) -> str:
    return "[" + words(xs)[1:-1] + "]"


def without(x: str, stop) -> str:
    return f"array_to_string(list_filter(string_split({norm(x)}, ' '), lambda t: NOT list_contains({listed(stop)}, t)), ' ')"


_DASHED = f"trim(regexp_replace(regexp_replace(lower({strip('text')}), 'https?://', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"


def _slug(n: int) -> str:
    return f"coalesce(nullif(trim(substr({_DASHED}, 1, {n}), '-'), ''), substr(sha1(text), 1, 12))"


_STORE = f"lower(trim(regexp_replace({strip('text')}, '[^A-Za-z0-9_.-]+', '-', 'g'), '-'))"


def likely_sql(a: str, b: str, threshold: float) -> str:
    """Whether two texts hold enough equal letters, in any order, for the ratio of matching blocks."""
    n = f"{threshold} * (length({a}) + length({b})) - 1e-9"
    common = f"list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, '')))))"
    return f"(2 * least(length({a}), length({b})) >= {n} AND 2 * {common} >= {n})"


_BLOCK = "list_filter(flatten(list_transform(range(least(length(a), length(b)), 0, -1), lambda k: list_transform(range(1, length(a) - k + 2), lambda i: substr(a, i, k)))), lambda s: contains(b, s))[1]"


def blocks_sql(pairs: str) -> str:
    """blocks(l, r, ratio) of the texts (l, r) of ``pairs``: the longest common block, then the same before and after it. Needs WITH RECURSIVE."""
    rest = "struct_pack(a := left(a, strpos(a, z) - 1), b := left(b, strpos(b, z) - 1)), struct_pack(a := substr(a, strpos(a, z) + length(z)), b := substr(b, strpos(b, z) + length(z)))"
    return f"""seg AS (SELECT l, r, l AS a, r AS b FROM {pairs}
        UNION ALL SELECT l, r, a, b FROM (SELECT l, r, unnest([{rest}], recursive := true) FROM (SELECT l, r, a, b, {_BLOCK} AS z FROM seg) WHERE z IS NOT NULL) WHERE a <> '' AND b <> ''),
    blocks AS (SELECT l, r, sum(length({_BLOCK})) * 2.0 / (length(l) + length(r)) AS ratio FROM seg GROUP BY l, r)"""


@query(
    "C01_slug",
    f"SELECT doc_id, {_slug(96)} AS slug96, {_slug(80)} AS slug80, CASE WHEN {_STORE} = '' THEN 'item' ELSE {_STORE} END AS store_slug FROM documents",
)
def slugs(t):
    x = F.col("text")
    return t.documents.select("doc_id", T.slug(x, 96).alias("slug96"), T.slug(x, 80).alias("slug80"), T.store_slug(x).alias("store_slug"))


@query(
    "C01_graph_slug",
    r"""WITH s AS (SELECT doc_id, source, lang, regexp_replace(lower(text), '[^\p{L}\p{N}\-_ /:]', '', 'g') AS k FROM documents)
    SELECT doc_id, trim(regexp_replace(k, '[-_ /:]+', '-', 'g'), '-') AS graph_slug,
           'edge:' || source || ':written-in:' || lang || ':' || substr(sha1(source || '|written_in|' || lang || '|'), 1, 12) AS edge_id
    FROM s""",
)
def graph_slugs(t):
    # a line break is no separator: it goes before the blanks are joined
    edge = T.edge_id(F.col("source"), F.lit("written_in"), F.col("lang"), F.lit(None).cast("string"))
    return t.documents.select("doc_id", T.graph_slug(F.col("text")).alias("graph_slug"), edge.alias("edge_id"))


@query("C02_sha256", "SELECT doc_id, sha256(text) AS text_hash, length(text) AS n_chars FROM documents")
def hashes(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("n_chars"))


@query(
    "C03_stable_id",
    """SELECT doc_id, 'doc:' || substr(sha1(source || '|' || lang || '|' || doc_id || '|' || text), 1, 16) AS id,
       'unit:text:' || substr(sha1(source || chr(0) || 'text' || chr(0) || '1' || chr(0) || substr(text, 1, 160)), 1, 12) AS unit_id FROM documents""",
)
def ids(t):
    from ..sources.units import unit_id

    return t.documents.select(
        "doc_id",
        T.stable_id("doc", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.col("text")).alias("id"),
        unit_id(F.col("source"), F.lit("text"), F.lit(1), F.col("text")).alias("unit_id"),
    )


_SPACED = f"regexp_replace({UNIX.format('text')}, '[ \\t\\f\\x0b]+', ' ', 'g')"


@query(
    "C04_normalize_space",
    rf"""SELECT doc_id, {strip(rf"regexp_replace({_SPACED}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")} AS spaced,
        trim(regexp_replace(text, '[\s\x0b\x85\p{{Z}}]+', ' ', 'g')) AS collapsed FROM documents""",
)
def spaces(t):
    return t.documents.select("doc_id", T.normalize_space(F.col("text")).alias("spaced"), T.collapse_space(F.col("text")).alias("collapsed"))


@query(
    "C05_normalize_structured",
    f"""SELECT page_id, {strip(rf"regexp_replace({UNIX.format('html')}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")} AS structured FROM pages""",
)
def structured(t):
    return t.pages.select("page_id", T.normalize_structured(F.col("html")).alias("structured"))


@query(
    "C06_tokenize",
    f"""WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '{T.TOKEN}') AS tokens FROM documents)
    SELECT doc_id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct, sha256(array_to_string(tokens, ' ')) AS tokens_hash FROM k""",
)
def tokens(t):
    k = t.documents.select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    return k.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"),
        F.sha2(F.array_join("tokens", " "), 256).alias("tokens_hash"),
    )


@query(
    "C07_token_estimate",
    """SELECT source, CAST(sum(greatest(1, ceil(length(text) / 4))) AS BIGINT) AS tokens,
       round(sum(greatest(1, ceil(length(text) / 4))) * 0.02 / 1000000, 8) AS cost FROM documents GROUP BY source""",
)
def token_estimates(t):
    n = F.sum(T.estimate_tokens(F.col("text")))
    return t.documents.groupBy("source").agg(n.alias("tokens")).withColumn("cost", F.round(T.embedding_cost(F.col("tokens"), "text-embedding-3-small"), 8))


@query("C08_normalize_text", f"SELECT doc_id, {norm('text')} AS normalized FROM documents")
def normalized(t):
    return t.documents.select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query(
    "C09_entity_names",
    f"SELECT doc_id, {without('text', T.NAME_STOP)} AS name_key, {without('text', T.ENTITY_STOP)} AS entity_key FROM documents",
)
def entity_names(t):
    x = F.col("text")
    return t.documents.select("doc_id", T.normalize_name(x).alias("name_key"), T.normalize_entity(x).alias("entity_key"))


_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?'"


@query(
    "C10_canonical_url",
    rf"""WITH p AS (
        SELECT page_id, url, regexp_extract(trim(url), {_URL}, 1) AS s, regexp_extract(trim(url), {_URL}, 2) AS h,
               regexp_replace(regexp_extract(trim(url), {_URL}, 3), '/+$', '') AS p,
               list_filter(string_split(regexp_extract(trim(url), {_URL}, 4), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')) AS q
        FROM pages)
    SELECT page_id, lower(s) || '://' || lower(h) || CASE WHEN p = '' THEN '/' ELSE p END
        || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_transform(q, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') END AS canonical
    FROM p""",
)
def urls(t):
    return t.pages.select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


_POS = "\\b(" + "|".join(T.POSITIVE_TERMS) + ")\\b"


def polarity_sql(x: str, fixed: bool = False) -> str:
    neg = (T.NEGATIVE_FIXED if fixed else T.NEGATIVE).replace("'", "''")
    return f"CASE WHEN regexp_matches({norm(x)}, '{neg}') THEN 'negative' WHEN regexp_matches({norm(x)}, '{_POS}') THEN 'positive' ELSE 'neutral' END"


def subject_sql(x: str) -> str:
    kept = f"list_filter(string_split({norm(x)}, ' '), lambda t: NOT list_contains({listed(T.SUBJECT_STOP)}, t) AND length(t) > 2)"
    return f"array_to_string(list_sort(list_distinct({kept}))[1:10], ' ')"


@query(
    "C11_polarity",
    f"""SELECT conv_id, turn, {polarity_sql('text')} AS polarity, {polarity_sql('text', True)} AS polarity_fixed FROM conversations""",
)
def polarities(t):
    x = F.col("text")
    return t.conversations.select("conv_id", "turn", T.polarity(x).alias("polarity"), T.polarity(x, True).alias("polarity_fixed"))


@query("C12_subject_key", f"SELECT doc_id, {subject_sql('text')} AS subject_key FROM documents")
def subjects(t):
    return t.documents.select("doc_id", T.subject_key(F.col("text")).alias("subject_key"))


@query(
    "C13_claim_text",
    rf"""WITH k AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN 'claim' ELSE 'note' END AS kind,
            trim(regexp_replace(text, '[\s\x0b\x85\p{{Z}}]+', ' ', 'g')) AS s FROM conversations)
    SELECT conv_id, turn, CASE WHEN kind = 'claim' THEN CASE WHEN s = '' THEN role ELSE s END
        WHEN regexp_matches(lower(s), '{T.MODAL.replace("'", "''")}') THEN s ELSE '' END AS claim FROM k""",
)
def claims(t):
    kind = F.when(F.col("role") == "assistant", F.lit("claim")).otherwise(F.lit("note"))
    return t.conversations.select("conv_id", "turn", T.claim_text(kind, F.col("role"), F.col("text")).alias("claim"))


@query(
    "C19_source_type",
    """WITH k AS (SELECT d.doc_id, CASE d.doc_id % 6 WHEN 0 THEN 'https://GitHub.com/x' WHEN 1 THEN 'https://arxiv.org/abs/1' WHEN 2 THEN 'https://x.org/docs/a'
            WHEN 3 THEN 'https://pypi.org/project/x' WHEN 4 THEN 'http://x.org' ELSE '/tmp/x' END AS ref, lower(text) AS s FROM documents d),
    c AS (SELECT doc_id, CASE WHEN contains(lower(ref), 'github.com') OR contains(s, 'pyproject.toml') OR contains(s, 'package.json') THEN 'repo'
            WHEN contains(lower(ref), 'pypi.org/project') OR contains(lower(ref), 'npmjs.com/package') THEN 'package'
            WHEN contains(lower(ref), 'arxiv.org') OR contains(lower(ref), 'doi.org') THEN 'paper'
            WHEN contains(lower(ref), '/docs') OR contains(s, 'documentation') THEN 'docs'
            WHEN starts_with(lower(ref), 'http://') OR starts_with(lower(ref), 'https://') THEN 'web' ELSE 'local' END AS source_type FROM k)
    SELECT doc_id, source_type, CASE WHEN source_type IN ('repo', 'package', 'paper', 'docs', 'survey') THEN 4 WHEN source_type = 'local' THEN 3 ELSE 2 END AS credibility FROM c""",
)
def source_types(t):
    refs = ["https://GitHub.com/x", "https://arxiv.org/abs/1", "https://x.org/docs/a", "https://pypi.org/project/x", "http://x.org", "/tmp/x"]
    ref = F.element_at(F.array(*map(F.lit, refs)), (F.col("doc_id") % 6 + 1).cast("int"))
    k = t.documents.select("doc_id", T.source_type(ref, F.col("text")).alias("source_type"))
    return k.withColumn("credibility", T.credibility_class(F.col("source_type")))


@query(
    "C20_title",
    rf"""WITH k AS (SELECT page_id, url, list_filter(string_split({UNIX.format('html')}, chr(10))[1:80], lambda x: starts_with({strip('x')}, '# ')) AS heads,
            regexp_replace(url, '/+$', '') AS bare FROM pages)
    SELECT page_id, CASE WHEN len(heads) > 0 THEN {strip(f"regexp_replace({strip('heads[1]')}, '^#+', '')")}
        WHEN list_last(string_split(bare, '/')) = '' THEN url ELSE list_last(string_split(bare, '/')) END AS title FROM k""",
)
def titles(t):
    return t.pages.select("page_id", T.title_of(F.col("url"), F.col("html")).alias("title"))


@query(
    "C21_summary",
    rf"""WITH k AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    c AS (SELECT conv_id, regexp_replace({strip('text')}, '\n{{3,}}', chr(10) || chr(10), 'g') AS clean FROM k),
    p AS (SELECT conv_id, clean, list_filter(list_transform(string_split(clean, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 40) AS parts FROM c)
    SELECT conv_id, {strip("substr(CASE WHEN len(parts) > 0 THEN array_to_string(parts[1:6], chr(10) || chr(10)) ELSE clean END, 1, 1800)")} AS summary FROM p""",
)
def summaries(t):
    # turns are ordered within their conversation before they are joined
    k = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return k.select("conv_id", T.summary_of(F.array_join("turns.text", "\n\n")).alias("summary"))


@query(
    "C22_document_class",
    """WITH k AS (SELECT d.doc_id, CASE d.doc_id % 6 WHEN 0 THEN '/w/research/captures/x' WHEN 1 THEN '/w/exports/x' WHEN 2 THEN '/w/watchlists/x'
            WHEN 3 THEN '/w/skills/x' WHEN 4 THEN '/w/runtimes/x' ELSE '/w/x' END AS path, CASE WHEN lang = 'es' THEN 'survey' ELSE '' END AS declared,
            CASE l.quality WHEN 1 THEN 0.8 WHEN 0 THEN 0.2 END AS q, CAST(1 + CAST(substr(source, 4) AS INT) % 5 AS INT) AS cred
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id, CASE WHEN declared <> '' THEN declared WHEN contains(path, '/research/captures/') THEN 'capture' WHEN contains(path, '/exports/') THEN 'export'
        WHEN contains(path, '/watchlists/') THEN 'watchlist' WHEN contains(path, '/skills/') THEN 'skill' WHEN contains(path, '/runtimes/') THEN 'runtime' ELSE 'local' END AS source_type,
        CASE WHEN q >= 0.75 THEN 'high' WHEN q < 0.35 THEN 'low' WHEN cred >= 4 THEN 'medium' WHEN cred >= 2 THEN 'low' ELSE 'medium' END AS confidence FROM k""",
)
def document_classes(t):
    paths = ["/w/research/captures/x", "/w/exports/x", "/w/watchlists/x", "/w/skills/x", "/w/runtimes/x", "/w/x"]
    path = F.element_at(F.array(*map(F.lit, paths)), (F.col("doc_id") % 6 + 1).cast("int"))
    k = t.documents.join(t.labels, "doc_id", "left")
    quality = F.when(F.col("quality") == 1, F.lit(0.8)).when(F.col("quality") == 0, F.lit(0.2))
    credibility = 1 + F.substring("source", 4, 10).cast("int") % 5
    return k.select(
        "doc_id",
        T.document_type(path, F.when(F.col("lang") == "es", F.lit("survey")).otherwise(F.lit(""))).alias("source_type"),
        T.document_confidence(quality, credibility).alias("confidence"),
    )


def concepts_sql(x: str, table) -> str:
    one = ", ".join(
        f"CASE WHEN {' OR '.join(f'contains({x}, $${w}$$)' for w in needles)} THEN '{k}' END".replace("$$", "'") for k, needles in table.items()
    )
    return f"array_to_string(list_filter([{one}], lambda c: c IS NOT NULL), ' ')"


@query(
    "C23_concepts",
    f"""WITH k AS (SELECT doc_id, lower(source || ' ' || lang || ' ' || text) AS h, lower(text) AS low FROM documents)
    SELECT doc_id, {concepts_sql('h', T.CONCEPTS)} AS nodes, {concepts_sql('low', T.PROPOSAL_CONCEPTS)} AS proposed FROM k""",
)
def tagged(t):
    head = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    return t.documents.select(
        "doc_id",
        F.array_join(T.concepts(head, T.CONCEPTS), " ").alias("nodes"),
        F.array_join(T.concepts(F.lower("text"), T.PROPOSAL_CONCEPTS), " ").alias("proposed"),
    )


_CLEAN = r"""trim(trim(regexp_replace({}, '[\s\x0b\x85\p{{Z}}]+', ' ', 'g')), ' ,.;:()[]{{}}"''')"""


@query(
    "C24_entity_type",
    f"""WITH k AS (SELECT p_partkey, p_name, lower({_CLEAN.format('p_name')}) AS low FROM part),
    w AS (SELECT p_partkey, low, list_filter(string_split(replace(low, '.', ''), ' '), lambda x: x <> '') AS ws FROM k)
    SELECT p_partkey, low AS cleaned, CASE WHEN low IN {words(T.LOCATION_HINTS)} THEN 'location' WHEN list_has_any(ws, {listed(T.ORG_HINTS)}) THEN 'organization'
        WHEN list_has_any(ws, {listed(T.PRODUCT_HINTS)}) THEN 'product'
        WHEN len(ws) = 2 AND regexp_matches(ws[1], '^\\p{{L}}') AND regexp_matches(ws[2], '^\\p{{L}}') THEN 'person' ELSE 'unknown' END AS entity_type FROM w""",
)
def entity_types(t):
    return t.part.select(
        "p_partkey", F.lower(T.clean_entity(F.col("p_name"))).alias("cleaned"), T.entity_type(F.col("p_name"), F.lit("")).alias("entity_type")
    )


@query(
    "C26_relation_key",
    f"""SELECT o_orderkey, {without("'Customer ' || o_custkey || ' Inc.'", T.ENTITY_STOP)} || '|placed|' || {without("'The ' || o_orderpriority || ' Co'", T.ENTITY_STOP)} AS relation_key,
        'text-entity:' || substr(sha1('organization|' || {without("'Customer ' || o_custkey || ' Inc.'", T.ENTITY_STOP)}), 1, 16) AS subject_id FROM orders""",
)
def relation_keys(t):
    subject = F.concat(F.lit("Customer "), F.col("o_custkey"), F.lit(" Inc."))
    obj = F.concat(F.lit("The "), F.col("o_orderpriority"), F.lit(" Co"))
    return t.orders.select(
        "o_orderkey",
        T.relation_key(subject, F.lit(" Placed "), obj).alias("relation_key"),
        T.stable_id("text-entity", F.lit("organization"), T.normalize_entity(subject)).alias("subject_id"),
    )


@query(
    "C28_crm_fields",
    """WITH k AS (SELECT o_orderkey, replace(printf('%.2f', o_totalprice), '.', ',') AS odd, CAST(o_totalprice AS VARCHAR) AS amount, o_orderpriority FROM orders)
    SELECT o_orderkey, coalesce(TRY_CAST(replace(amount, ',', '') AS DOUBLE), 0) AS amount, regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '', 'g') AS stage FROM k""",
)
def crm_fields(t):
    return t.orders.select(
        "o_orderkey", T.money(F.col("o_totalprice").cast("string")).alias("amount"), T.stage_key(F.col("o_orderpriority")).alias("stage")
    )


@query(
    "C30_date_window",
    """SELECT event_type, count(*) AS n, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_day FROM events
       WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-31' - 14 AND DATE '2024-01-31' GROUP BY event_type""",
)
def date_window(t):
    from ..functions.dates import in_window

    day = F.to_date("ts")
    return t.events.where(in_window(day, end="2024-01-31", days=14)).groupBy("event_type").agg(
        F.count("*").alias("n"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day")
    )


@query(
    "C32_provenance_warnings",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 1 WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS n_warnings,
       CASE WHEN d.doc_id % 3 = 0 THEN 'governance: result has no source_id; validate before using as durable knowledge'
            WHEN l.doc_id IS NULL THEN 'governance: result has a source_id but no capture_id; provenance may be incomplete' ELSE '' END AS warnings
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def warnings(t):
    k = t.documents.join(t.labels.select("doc_id", F.lit("cap").alias("cap")), "doc_id", "left")
    found = T.provenance_warnings(F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.col("cap"))
    return k.select("doc_id", F.size(found).alias("n_warnings"), F.array_join(found, "; ").alias("warnings"))


@query(
    "C34_worst_decision",
    """WITH k AS (SELECT doc_id, list_value('allow', 'warn', 'require_review', 'block') AS d, 1 + doc_id % 4 AS a, 1 + length(text) % 4 AS b FROM documents)
    SELECT doc_id, d[greatest(a, b)] AS decision FROM k""",
)
def worst(t):
    d = F.array(*map(F.lit, T.DECISIONS))
    at = lambda c: F.element_at(d, (1 + c % 4).cast("int"))
    return t.documents.select("doc_id", T.worst_decision(at(F.col("doc_id")), at(F.length("text"))).alias("decision"))


@query(
    "C36_fts_query",
    f"""WITH k AS (SELECT item_id, regexp_extract_all(lower(text), '{T.TOKEN}')[1:12] AS terms FROM benchmark)
    SELECT item_id, CASE WHEN len(terms) = 0 THEN '""' ELSE array_to_string(list_transform(terms, lambda x: '"' || x || '"'), ' OR ') END AS query FROM k""",
)
def fts_queries(t):
    return t.benchmark.select("item_id", T.fts_query(F.col("text")).alias("query"))
