"""Operational evidence: metric rollups of several systems, their reconciliation, selection and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ratio(a: Column, b: Column, places: int) -> Column:
    """a / b to so many places; 0 where b is 0 or nothing."""
    return F.coalesce(F.round(F.try_divide(a, F.nullif(b, F.lit(0))), places), F.lit(0.0))


def ads_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Campaign metrics from cost_micros, impressions, clicks, conversions, conversions_value."""
    s = rows.groupBy(*by).agg(
        F.round(F.sum("cost_micros") / 1_000_000, 2).alias("spend"),
        *(F.sum(c).alias(c) for c in ("impressions", "clicks")),
        F.sum("conversions").alias("_conversions"),
        F.sum("conversions_value").alias("_value"),
    )
    c = F.col
    return s.select(
        *by, "spend", "impressions", "clicks",
        ratio(c("clicks"), c("impressions"), 4).alias("ctr"),
        ratio(c("spend"), c("clicks"), 2).alias("cpc"),
        ratio(c("spend") * 1000, c("impressions"), 2).alias("cpm"),
        F.round("_conversions", 4).alias("conversions"),
        F.round("_value", 2).alias("conversion_value"),
        ratio(c("_conversions"), c("clicks"), 4).alias("conversion_rate"),
    )


def mapped_conversions(rows: DataFrame, definitions: DataFrame, by: list[str]) -> DataFrame:
    """Conversions whose name matches a definition (name, weight), weighted; others are only counted.

    The definitions are configuration, a few rows.
    """
    key = T.conversion_name(F.col("name"))
    first = Window.partitionBy("_key").orderBy("priority")
    d = definitions.select(key.alias("_key"), "weight", "priority").withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "priority")
    j = rows.withColumn("_key", T.conversion_name(F.col("conversion_name"))).join(d, "_key", "left")
    return j.groupBy(*by).agg(
        F.round(F.coalesce(F.sum(F.col("conversions") * F.col("weight")), F.lit(0.0)), 4).alias("conversions"),
        F.round(F.coalesce(F.sum(F.col("conversions_value") * F.col("weight")), F.lit(0.0)), 2).alias("conversion_value"),
        F.count_if(F.col("weight").isNull()).alias("ignored_rows"),
    )


def analytics_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sessions, key events, the session-weighted engagement rate and the conversion rate."""
    weighted = F.when(F.col("engagement_rate").isNotNull() & (F.col("sessions") > 0), F.col("sessions"))
    s = rows.groupBy(*by).agg(
        F.sum("sessions").alias("sessions"),
        F.sum("key_events").alias("key_events"),
        F.sum(F.col("engagement_rate") * weighted).alias("_er"),
        F.sum(weighted).alias("_w"),
    )
    return s.select(
        *by, "sessions", "key_events",
        ratio(F.col("_er"), F.col("_w"), 4).alias("engagement_rate"),
        ratio(F.col("key_events"), F.col("sessions"), 4).alias("conversion_rate"),
    )


# Default stage names.
MQL, SQL_STAGES, WON, LOST = ("marketingqualifiedlead", "mql"), ("salesqualifiedlead", "sql"), ("closedwon",), ("closedlost",)


def crm_metrics(contacts: DataFrame, created: DataFrame, closed: DataFrame, by: str, won: tuple[str, ...] = WON, lost: tuple[str, ...] = LOST) -> DataFrame:
    """Leads and their stages, opportunities, the pipeline without lost deals, and what was won."""
    stage = T.stage_key(F.col("stage"))
    a = contacts.groupBy(by).agg(
        F.count("*").alias("leads"), F.count_if(stage.isin(*MQL)).alias("mqls"), F.count_if(stage.isin(*SQL_STAGES)).alias("sqls")
    )
    amount = T.money(F.col("amount"))
    b = created.groupBy(by).agg(F.count("*").alias("opportunities"), F.round(F.sum(F.when(stage.isin(*lost), 0.0).otherwise(amount)), 2).alias("pipeline_amount"))
    c = closed.groupBy(by).agg(F.round(F.sum(F.when(stage.isin(*won), amount).otherwise(0.0)), 2).alias("closed_won_revenue"))
    return a.join(b, by, "full").join(c, by, "full").na.fill(0)


def contact_hygiene(rows: DataFrame, by: list[str], suppressed: tuple[str, ...], cutoff: Column) -> DataFrame:
    """Contacts, accounts, missing e-mail addresses, suppressed and stale rows."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("contacts"),
        F.countDistinct("account_id").alias("accounts"),
        F.count_if(F.coalesce("email", F.lit("")) == "").alias("missing_email_count"),
        F.count_if(F.lower("email_status").isin(*suppressed)).alias("suppressed_count"),
        F.count_if(F.col("updated_at") < cutoff).alias("stale_record_count"),
    )


def signal_rollup(rows: DataFrame, by: list[str], approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return rows.groupBy(*by).agg(
        F.count("*").alias("buyer_signal_count"), F.avg("strength").alias("avg_signal_strength"),
        distinct("account_id").alias("accounts"), distinct("contact_id").alias("contacts"),
    )


def outcome_rollup(rows: DataFrame, by: list[str], sums: list[str], numerator: str, denominator: str) -> DataFrame:
    s = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), F.try_divide(F.sum(numerator), F.nullif(F.sum(denominator), F.lit(0))).alias("conversion_rate"))
    return s


def reconcile(metrics: DataFrame) -> DataFrame:
    """Conflicts between systems from long metrics (client_id, kind, metric, value).

    CRM against ads leads (from .10, high from .35), ads against analytics conversions and analytics against CRM
    leads (from .20, high from .50; key events stand in for conversions), ad spend without sessions.
    """
    v = lambda kind, metric: F.sum(F.when((F.col("kind") == kind) & (F.col("metric") == metric), F.col("value")))
    wide = metrics.groupBy("client_id").agg(
        v("crm", "leads").alias("crm_leads"), v("ads", "leads").alias("ads_leads"), v("ads", "conversions").alias("ads_conv"),
        F.coalesce(v("analytics", "conversions"), v("analytics", "key_events")).alias("an_conv_or_key"), v("analytics", "conversions").alias("an_conv"),
        F.coalesce(v("ads", "spend"), F.lit(0.0)).alias("spend"), F.coalesce(v("analytics", "sessions"), F.lit(0.0)).alias("sessions"),
    )
    c = F.col
    delta = lambda a, b: F.abs(c(a) - c(b)) / F.greatest(F.abs(c(b)), F.lit(1.0))
    rule = lambda name, d, low, high: F.when(d >= low, F.struct(F.lit(name).alias("conflict_type"), F.when(d < high, "medium").otherwise("high").alias("severity"), F.round(d, 4).alias("relative_delta")))
    spend = F.when((c("spend") > 0) & (c("sessions") <= 0), F.struct(F.lit("ad_spend_without_sessions").alias("conflict_type"), F.lit("high").alias("severity"), F.lit(None).cast("double").alias("relative_delta")))
    rules = F.array_compact(
        F.array(
            rule("crm_vs_ad_leads", delta("ads_leads", "crm_leads"), 0.10, 0.35),
            rule("ads_vs_analytics_conversions", delta("ads_conv", "an_conv"), 0.20, 0.50),
            rule("analytics_vs_crm_leads", delta("an_conv_or_key", "crm_leads"), 0.20, 0.50),
            spend,
        )
    )
    return wide.select("client_id", F.explode(rules).alias("r")).select("client_id", "r.*")


def selected_metrics(rows: DataFrame, priority: list[str]) -> DataFrame:
    """One value for each client and metric: of the provider whose kind comes first in the priority, then by name."""
    rank = T.lookup(F.col("kind"), {k: float(i) for i, k in enumerate(priority)}, float(len(priority)))
    w = Window.partitionBy("client_id", "metric").orderBy(rank, "provider")
    lineage = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "provider"))), lambda x: x["provider"]), ",")
    all_ = rows.groupBy("client_id", "metric").agg(lineage.alias("candidates"))
    best = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("client_id", "metric", "provider", "value")
    return best.join(all_, ["client_id", "metric"])


def data_quality(conflicts: DataFrame, clients: DataFrame) -> DataFrame:
    """(client_id, status, score) from open conflicts and whether data is partial (client_id, partial)."""
    live = conflicts.where(F.col("status").isin("open", "acknowledged"))
    k = live.groupBy("client_id").agg(F.bool_or(F.col("severity") == "high").alias("high"))
    p, high, some = F.col("partial"), F.coalesce("high", F.lit(False)), F.col("high").isNotNull()
    j = clients.join(k, "client_id", "left")
    return j.select(
        "client_id",
        F.when(some & p, "partial_conflicted").when(some, "conflicted").when(p, "partial").otherwise("ok").alias("quality"),
        F.when(p & high, 0.35).when(high, 0.50).when(some & p, 0.55).when(some, 0.70).when(p, 0.75).otherwise(1.0).alias("score"),
    )


def latest(cards: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("fresh_at"), F.desc("evidence_id"))
    return cards.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def freshness_status(fresh_at: Column, sla_hours: Column, now: Column) -> Column:
    return F.when((F.unix_micros(now) - F.unix_micros(fresh_at.cast("timestamp"))) / 3600e6 > sla_hours, "stale").otherwise("fresh")
