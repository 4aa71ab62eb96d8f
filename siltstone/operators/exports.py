"""Renderings: evidence as source documents, context packs, and redaction of configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What follows the summary in each context pack.
GUIDANCE = {
    "weekly_gtm_review": ("Weekly GTM Review", "Operating Readout", (
        "Treat CRM metrics as source-of-truth for pipeline unless the client capsule says otherwise.",
        "Treat ad-platform conversion metrics as directional until confirmed by CRM.",
        "If warnings are present, mention them before making budget recommendations.",
    )),
    "reach_drop_diagnosis": ("Reach Drop Diagnosis", "Diagnosis Starting Point", (
        "Spend trend versus reach trend.", "Frequency or audience saturation if available.", "CTR and CPC movement.",
        "CRM-confirmed lead and opportunity movement.", "Attribution mismatch warnings.",
    )),
    "pipeline_health_check": ("Pipeline Health Check", "Pipeline Readout", (
        "Compare lead volume with opportunity creation before blaming traffic.",
        "Call out stale CRM evidence before making revenue claims.", "Separate pipeline amount from closed-won revenue.",
    )),
}
SECRET = ("token", "secret", "password", "credential")


def bullets(items: Column, none: str) -> Column:
    """Items as a list, or a sentence where there are none."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(f"- {none}"))


def metric_lines(metrics: Column) -> Column:
    """``metric: value (source: provider)`` for each of an array of struct(metric, value, provider), by metric."""
    line = lambda m: F.concat(m["metric"], F.lit(": "), m["value"].cast("string"), F.when(m["provider"] != "", F.concat(F.lit(" (source: "), m["provider"], F.lit(")"))).otherwise(F.lit("")))
    return bullets(F.transform(F.array_sort(metrics), line), "No metrics captured.")


def evidence_source(cards: DataFrame) -> DataFrame:
    """(evidence_id, markdown): cards rendered as documents that can be ingested again."""
    head = F.concat_ws("\n", *(F.concat(F.lit(f"- {c}: `"), F.col(c).cast("string"), F.lit("`")) for c in ("evidence_id", "client_id", "query_id", "quality")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Evidence: "), "query_id", F.lit(" / "), "client_id"), F.lit(""), head, F.lit(""),
        F.lit("## Metrics"), F.lit(""), metric_lines(F.col("metrics")), F.lit(""), F.lit("## Conflicts"), F.lit(""), bullets(F.col("conflicts"), "No conflicts recorded."), F.lit(""),
    )
    return cards.select("evidence_id", text.alias("markdown"))


def context_pack(cards: DataFrame, template: str) -> DataFrame:
    """(evidence_id, pack): a card under one of the templates, or a plain one."""
    title, readout, advice = GUIDANCE.get(template, (template, "Summary", ()))
    parts = [F.lit(f"# {title}"), F.lit(""), F.concat(F.lit("- client: `"), "client_id", F.lit("`")), F.concat(F.lit("- evidence: `"), "evidence_id", F.lit("`")), F.lit("")]
    parts += [F.lit(f"## {readout}"), F.lit(""), F.concat(F.lit("Quality: "), "quality"), F.lit(""), F.lit("## Metrics"), F.lit(""), metric_lines(F.col("metrics")), F.lit("")]
    if advice:
        parts += [F.lit("## Guidance"), F.lit(""), F.lit("\n".join(f"- {a}" for a in advice)), F.lit("")]
    parts += [F.lit("## Conflicts"), F.lit(""), bullets(F.col("conflicts"), "No conflicts recorded.")]
    return cards.select("evidence_id", F.concat_ws("\n", *parts).alias("pack"))


def capture_source_id(query_id: Column, client_id: Column, prefix: str = "src:reach-evidence") -> Column:
    """The source that captures of one query's evidence for one client are versions of."""
    digest = F.substring(F.sha2(F.concat_ws("|", query_id, client_id), 256), 1, 8)
    return F.concat_ws(":", F.lit(prefix), query_id, client_id, digest)


def top_sources(sources: DataFrame, limit: int = 25) -> DataFrame:
    """Sources in use, the most credible first, then the newest, as rows and lines of a reference list."""
    used = sources.where("status != 'deprecated'").orderBy(F.desc("credibility_score"), F.desc("n"), "id").limit(limit)
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(") (credibility "), F.col("credibility_score").cast("string"), F.lit(")"))
    return used.select("id", "title", "credibility_score", line.alias("line"))


def redacted(config: Column) -> Column:
    """A map of settings without secrets: keys that speak of one lose their value unless they name a variable."""
    secret = lambda k: F.lower(k).rlike("|".join(SECRET)) & ~F.lower(k).endswith("_env")
    return F.transform_values(config, lambda k, v: F.when(secret(k), F.lit("[REDACTED]")).otherwise(v))


def capture_url(url: Column, canonical: Column, arxiv: Column, doi: Column, pdf: Column) -> Column:
    """The address to capture of a research hit, best first."""
    after = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(has(arxiv), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))
        .when(canonical.startswith("arxiv:"), F.concat(F.lit("https://arxiv.org/abs/"), after(canonical)))
        .when(has(pdf), pdf)
        .when(has(url) & ~F.contains(url, F.lit("semanticscholar.org")), url)
        .when(has(doi), F.concat(F.lit("https://doi.org/"), doi))
        .when(canonical.startswith("s2:"), F.concat(F.lit("https://www.semanticscholar.org/paper/"), after(canonical)))
        .when(canonical.startswith("http://") | canonical.startswith("https://"), canonical)
        .when(has(url), url)
    )
