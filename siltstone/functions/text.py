"""Scalar text functions as Column expressions: normal forms, identifiers, tokens, polarity, classes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and patterns that results depend on.
TOKEN = r"[a-z0-9][a-z0-9_+\-./]{1,}"
NAME_STOP = ("dr", "mr", "mrs", "ms", "miss", "prof", "the", "a", "an", "inc", "llc", "ltd")
ENTITY_STOP = ("the", "a", "an", "inc", "llc", "ltd", "corp", "corporation", "co", "company")
NEGATIVE = r"\b(do not|don't|should not|must not|no longer|never|avoid|forbid|reject|disable|deprecated)\b"
NEGATIVE_FIXED = r"\b(do not|don t|does not|should not|must not|no longer|never|avoid|forbid|reject|disable|deprecated)\b"
NEGATIVE_TERMS = ("avoid", "forbid", "forbidden", "never", "not", "reject", "remove", "disable", "deny", "deprecated", "deprecate")
POSITIVE_TERMS = (
    "use", "uses", "using", "prefer", "preferred", "recommend", "recommended", "require", "requires", "required",
    "enable", "enabled", "allow", "allowed", "support", "supports",
)
SUBJECT_STOP = (
    "a", "an", "and", "are", "as", "be", "by", "can", "for", "from", "if", "in", "into", "is", "it", "of", "on", "or",
    "should", "that", "the", "then", "this", "to", "with", *NEGATIVE_TERMS, *POSITIVE_TERMS,
)
CLAIM_TYPES = ("claim", "practice", "pattern", "failure_mode", "policy", "rule", "concept")
MODAL = r"\b(should|must|avoid|recommend|prefer|do not|don't|never|requires?)\b"
CONFIDENCE_SCORES = {"high": 1.0, "medium": 0.7, "low": 0.35, "unknown": 0.5, "": 0.5}
STATUS_SCORES = {
    "active": 1.0, "accepted": 1.0, "provisional": 0.75, "proposed": 0.65, "new": 0.65, "stale_pending_refresh": 0.45,
    "acknowledged": 0.45, "deprecated": 0.0, "reverted": 0.0, "merged": 0.0, "suppressed": 0.0, "resolved": 0.0,
}
SEVERITY_PENALTIES = {"high": 0.35, "medium": 0.22, "low": 0.12}
EMBEDDING_PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13}
CONCEPTS = {
    "concept:rag": ("rag", "retrieval augmented", "retrieval-augmented"),
    "concept:skill": ("skill", "skill.md", "agent skill"),
    "concept:knowledge-graph": ("knowledge graph", "skillgraph"),
    "concept:context-distillation": ("context distillation",),
    "concept:task-semantic-contract": ("semantic contract", "task contract"),
    "concept:divergence-detection": ("divergence", "drift"),
    "concept:side-effect-boundary": ("side effect", "side-effect"),
    "concept:quorum-governance": ("quorum",),
    "concept:deterministic-replay": ("replay", "deterministic"),
}
PROPOSAL_CONCEPTS = {
    "concept:deterministic-replay": ("deterministic replay", "replay", "reconstruct"),
    "concept:consent-bound-context": ("consent", "grant", "revocation", "purpose"),
    "concept:tamper-evident-audit": ("sigchain", "tamper", "audit", "ed25519", "hash chain", "append-only"),
    "concept:deterministic-policy-enforcement": (
        "deterministic policy", "policy enforcement", "formal verification", "z3", "opa", "cedar",
    ),
    "concept:tool-guardrails": ("tool guard", "tool gating", "guardrail", "before execution", "pre-execution"),
    "concept:pre-work-sync": ("pre-work", "synchronization", "assumptions"),
    "concept:task-semantic-contract": ("task contract", "semantic contract", "acceptance criteria"),
    "concept:reasoning-branch-merge": ("branch", "merge", "rationale", "reasoning"),
    "concept:context-distillation": ("context distillation", "context compression", "context slice"),
    "concept:divergence-detection": ("divergence", "drift detection", "misalignment"),
}
ORG_HINTS = (
    "agency", "analytics", "bank", "clinic", "co", "company", "corp", "corporation", "group", "hospital", "inc", "labs",
    "llc", "ltd", "systems", "technologies", "university",
)
LOCATION_HINTS = (
    "atlanta", "austin", "boston", "chicago", "dallas", "denver", "london", "new york", "paris", "san francisco",
    "seattle", "toronto", "vancouver",
)
PRODUCT_HINTS = ("platform", "suite", "cloud", "crm", "erp", "database", "warehouse", "app")
ORG_PREDICATES = ("acquired", "owned_by", "customer_of", "supplier_of", "partners_with", "competitor_of", "part_of")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lookup(c: Column, table: dict[str, float], default: float) -> Column:
    """Value of a fixed table for a key, through one chain of conditions that stays in generated code."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def slug(c: Column, max_len: int = 96) -> Column:
    """Lower-case words joined by dashes; a digest where nothing is left."""
    digest = F.substring(F.sha1(c), 1, 12)
    low = F.regexp_replace(F.lower(strip(c)), "https?://", "")
    dashed = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, max_len), "^-+|-+$", "")
    return F.when(cut == "", digest).otherwise(cut)


def store_slug(c: Column) -> Column:
    """File-name slug: letters, digits, dot, dash and underscore stay."""
    out = F.lower(F.regexp_replace(F.regexp_replace(strip(c), "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", ""))
    return F.when(out == "", F.lit("item")).otherwise(out)


def graph_slug(c: Column) -> Column:
    """Node slug: letters and digits of any script stay, separators become single dashes, the rest goes."""
    kept = F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}\-_ /:]", "")
    out = F.regexp_replace(F.regexp_replace(kept, r"[-_ /:]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.substring(F.sha1(c), 1, 12)).otherwise(out)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def edge_id(source: Column, relation: Column, target: Column, evidence: Column) -> Column:
    digest = F.substring(F.sha1(F.concat_ws("|", source, relation, target, F.coalesce(evidence, F.lit("")))), 1, 12)
    return F.concat_ws(":", F.lit("edge"), graph_slug(source), graph_slug(relation), graph_slug(target), digest)


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")


def normalize_space(c: Column) -> Column:
    out = F.regexp_replace(unix_lines(c), "[ \t\f\\x0b]+", " ")
    return strip(F.regexp_replace(out, "\n{4,}", "\n\n\n"))


def normalize_structured(c: Column) -> Column:
    return strip(F.regexp_replace(unix_lines(c), "\n{4,}", "\n\n\n"))


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("long")


def embedding_cost(tokens: Column, model: str) -> Column:
    return tokens * F.lit(EMBEDDING_PRICES.get(model, 0.0)) / 1_000_000


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " "))


def _without(c: Column, stop: Iterable[str]) -> Column:
    return F.array_join(F.filter(F.split(normalize_text(c), " "), lambda t: ~t.isin(*stop)), " ")


def normalize_name(c: Column) -> Column:
    """Names without titles, articles and company suffixes."""
    return _without(c, NAME_STOP)


def normalize_entity(c: Column) -> Column:
    """Entity texts without articles and the longer list of company suffixes."""
    return _without(c, ENTITY_STOP)


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, no fragment, no closing slash; else plain words."""
    url = F.trim(text_or_empty(c))
    part = lambda g: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", g)
    path = F.regexp_replace(part(3), "/+$", "")
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    pairs = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    out = F.concat(
        F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", F.lit("/")).otherwise(path),
        F.when(pairs == "", F.lit("")).otherwise(F.concat(F.lit("?"), pairs)),
    )
    return F.when(url == "", F.lit("")).when(part(2) == "", normalize_text(url)).otherwise(out)


def polarity(c: Column, fixed: bool = False) -> Column:
    """negative, positive or neutral. The plain rule misses "don't", whose apostrophe is gone; ``fixed`` finds it."""
    t = normalize_text(c)
    return (
        F.when(t.rlike(NEGATIVE_FIXED if fixed else NEGATIVE), F.lit("negative"))
        .when(t.rlike(r"\b(" + "|".join(POSITIVE_TERMS) + r")\b"), F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )


def subject_key(c: Column) -> Column:
    words = F.filter(F.split(normalize_text(c), " "), lambda t: ~t.isin(*SUBJECT_STOP) & (F.length(t) > 2))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 10), " ")


def claim_text(kind: Column, name: Column, summary: Column) -> Column:
    s = collapse_space(text_or_empty(summary))
    return (
        F.when(kind.isin(*CLAIM_TYPES), F.when(s == "", name).otherwise(s))
        .when(F.lower(s).rlike(MODAL), s)
        .otherwise(F.lit(""))
    )


def confidence_score(c: Column) -> Column:
    return lookup(F.lower(F.trim(text_or_empty(c))), CONFIDENCE_SCORES, 0.5)


def status_score(c: Column) -> Column:
    return lookup(F.lower(F.trim(text_or_empty(c))), STATUS_SCORES, 0.55)


def credibility_score(c: Column) -> Column:
    v = c.try_cast("double")
    return F.coalesce(clamp(v / 5.0), F.lit(0.5))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def freshness_score(checked: Column, window: Column, now: Column) -> Column:
    """1 inside the window, .65 inside twice the window, .25 beyond, .55 unknown."""
    days = F.greatest(F.coalesce(F.when(window == 0, F.lit(30)).otherwise(window), F.lit(30)), F.lit(1))
    age = F.greatest((F.unix_micros(now) - F.unix_micros(checked)) / 86400e6, F.lit(0.0))
    return F.when(checked.isNull(), F.lit(0.55)).when(age <= days, F.lit(1.0)).when(age <= days * 2, F.lit(0.65)).otherwise(F.lit(0.25))


def trust_score(chunk_confidence: Column, credibility: Column, has_source: Column) -> Column:
    chunk = confidence_score(chunk_confidence)
    return clamp(F.when(has_source, chunk * 0.55 + credibility_score(credibility) * 0.45).otherwise(chunk))


def combined_status(chunk_status: Column, source_status: Column, has_source: Column) -> Column:
    return F.least(status_score(chunk_status), F.when(has_source, status_score(source_status)).otherwise(F.lit(1.0)))


def severity_penalty(severity: Column, status: Column) -> Column:
    """Penalty of one conflict; 0 unless it is open or acknowledged."""
    s = F.lower(F.coalesce(F.when(status != "", status), F.lit("open")))
    p = lookup(F.lower(F.coalesce(severity, F.lit("medium"))), SEVERITY_PENALTIES, 0.22)
    return F.when(s == "open", p).when(s == "acknowledged", p * 0.6).otherwise(F.lit(0.0))


def source_type(ref: Column, text: Column, chars: int | None = None) -> Column:
    """The kind of a source by its address and text; ``chars`` cuts the text, by default it is read whole."""
    low, sample = F.lower(ref), F.lower(text if chars is None else F.substring(text, 1, chars))
    has = lambda c, *needles: _any(c, needles)
    return (
        F.when(has(low, "github.com") | has(sample, "pyproject.toml", "package.json"), F.lit("repo"))
        .when(has(low, "pypi.org/project", "npmjs.com/package"), F.lit("package"))
        .when(has(low, "arxiv.org", "doi.org"), F.lit("paper"))
        .when(has(low, "/docs") | has(sample, "documentation"), F.lit("docs"))
        .when(low.startswith("http://") | low.startswith("https://"), F.lit("web"))
        .otherwise(F.lit("local"))
    )


def credibility_class(kind: Column) -> Column:
    return F.when(kind.isin("repo", "package", "paper", "docs", "survey"), 4).when(kind == "local", 3).otherwise(2)


def _any(c: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def title_of(ref: Column, text: Column, lines: int = 80) -> Column:
    """The first level-one heading among the first lines, else the reference's last part."""
    head = F.filter(F.slice(F.split(unix_lines(text), "\n"), 1, lines), lambda x: strip(x).startswith("# "))
    title = strip(F.regexp_replace(strip(F.get(head, 0)), "^#+", ""))
    bare = F.regexp_replace(ref, "/+$", "")
    tail = F.element_at(F.split(bare, "/"), -1)
    return F.when(F.size(head) > 0, title).when((tail == "") & ref.rlike("^https?://"), ref).otherwise(tail)


def summary_of(text: Column, max_chars: int = 1800) -> Column:
    clean = F.regexp_replace(strip(text), "\n{3,}", "\n\n")
    parts = F.filter(F.transform(F.split(clean, "\n\n"), strip), lambda p: F.length(p) > 40)
    joined = F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 6), "\n\n")).otherwise(clean)
    return strip(F.substring(joined, 1, max_chars))


def document_type(path: Column, declared: Column) -> Column:
    out = F.when(declared != "", declared)
    for needle, kind in (
        ("/research/captures/", "capture"), ("/exports/", "export"), ("/watchlists/", "watchlist"),
        ("/skills/", "skill"), ("/runtimes/", "runtime"),
    ):
        out = out.when(F.contains(path, F.lit(needle)), F.lit(kind))
    return out.otherwise(F.lit("local"))


def document_confidence(quality: Column, credibility: Column) -> Column:
    return (
        F.when(quality >= 0.75, F.lit("high"))
        .when(quality < 0.35, F.lit("low"))
        .when(credibility >= 4, F.lit("medium"))
        .when(credibility >= 2, F.lit("low"))
        .otherwise(F.lit("medium"))
    )


def concepts(haystack: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Concepts one of whose keywords occurs in the (lower-case) text, in table order."""
    return F.array_compact(F.array(*(F.when(_any(haystack, words), F.lit(k)) for k, words in table.items())))


def clean_entity(c: Column) -> Column:
    return F.regexp_replace(collapse_space(text_or_empty(c)), r"""^[ ,.;:()\[\]{}"']+|[ ,.;:()\[\]{}"']+$""", "")


def entity_type(c: Column, predicate: Column, role: str = "") -> Column:
    low = F.lower(clean_entity(c))
    words = F.filter(F.split(F.regexp_replace(low, r"\.", ""), " "), lambda w: w != "")
    has = lambda hints: F.exists(words, lambda w: w.isin(*hints))
    pair = (F.size(words) == 2) & F.forall(words, lambda w: w.rlike(r"^\p{L}"))
    return (
        F.when(low.isin(*LOCATION_HINTS), F.lit("location"))
        .when(has(ORG_HINTS), F.lit("organization"))
        .when(has(PRODUCT_HINTS), F.lit("product"))
        .when(predicate.isin(*ORG_PREDICATES), F.lit("organization"))
        .when((predicate == "based_in") & F.lit(role == "object"), F.lit("location"))
        .when(pair, F.lit("person"))
        .otherwise(F.lit("unknown"))
    )


def relation_key(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat_ws("|", normalize_entity(subject), F.lower(F.trim(text_or_empty(predicate))), normalize_entity(obj))


def conversion_name(c: Column) -> Column:
    return collapse_space(F.replace(F.lower(text_or_empty(c)), F.lit("_"), F.lit(" ")))


def money(c: Column) -> Column:
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def stage_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text_or_empty(c))), "[^a-z0-9]+", "")


def metric_number(c: Column) -> Column:
    """A metric as text: whole numbers without a fraction, others to four places, words as they are."""
    v = c.try_cast("double")
    return (
        F.when(v.isNull(), c)
        .when(v == F.floor(v), F.format_string("%d", v.cast("long")))
        .otherwise(F.round(v, 4).cast("string"))
    )


def fts_terms(c: Column, most: int = 12) -> Column:
    return F.slice(tokenize(c), 1, most)


def fts_query(c: Column) -> Column:
    terms = F.transform(fts_terms(c), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(terms) == 0, F.lit('""')).otherwise(F.array_join(terms, " OR "))


def provenance_warnings(source_id: Column, capture_id: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(
        F.array(
            F.when(~none(source_id) & none(capture_id), F.lit("governance: result has a source_id but no capture_id; provenance may be incomplete")),
            F.when(none(source_id), F.lit("governance: result has no source_id; validate before using as durable knowledge")),
        )
    )


DECISIONS = ("allow", "warn", "require_review", "block")


def worst_decision(*cs: Column) -> Column:
    rank = [F.array_position(F.array(*map(F.lit, DECISIONS)), c) for c in cs]
    return F.element_at(F.array(*map(F.lit, DECISIONS)), F.greatest(*rank, F.lit(1).cast("long")).cast("int"))


def is_live(status: Column) -> Column:
    return status.isin("active", "provisional")
