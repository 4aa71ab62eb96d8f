"""Named read-only metric contracts, their validation, and their run over connected systems as one plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as V
from ..sources.connectors import Connector

# Allowed levels and policies, and the metrics that contracts may return.
STORAGE_LEVELS = ("pointer", "metadata", "aggregate_summary", "redacted_sample")
PII_POLICIES = ("none", "redacted", "allowed")
METRICS = frozenset(
    """spend reach impressions clicks ctr cpc cpm conversions conversion_value conversion_rate leads mqls sqls opportunities
    pipeline_amount closed_won_revenue sessions active_users total_users event_count key_events revenue engagement_rate contacts
    accounts segment_size suppressed_count missing_email_count stale_record_count buyer_signal_count avg_signal_strength""".split()
)
OBJECT_FIELDS = {"contact": ("id", "created_at"), "opportunity": ("id", "created_at", "amount", "stage")}


@dataclass(frozen=True)
class Manifest:
    id: str
    description: str
    requires: tuple[str, ...]
    outputs: tuple[str, ...]
    parameters: tuple[str, ...] = ("client_id", "start_date", "end_date")
    source_priority: tuple[str, ...] = ()
    conflict_checks: tuple[str, ...] = ()
    storage_level: str = "aggregate_summary"
    pii_policy: str = "none"
    freshness_sla_hours: int = 24

    def errors(self) -> list[str]:
        checks = [
            (bool(self.id), "id is required"),
            (bool(self.description), "description is required"),
            (self.storage_level in STORAGE_LEVELS, f"unsupported storage level {self.storage_level}"),
            (self.pii_policy in PII_POLICIES, f"unsupported pii policy {self.pii_policy}"),
            (self.pii_policy == "none" or self.storage_level == "redacted_sample", "personal data needs redacted_sample storage"),
            (self.freshness_sla_hours > 0, "freshness_sla_hours must be positive"),
            *((m in METRICS, f"unknown metric {m}") for m in self.outputs),
        ]
        return [text for ok, text in checks if not ok]

    def parameter_errors(self, given: dict[str, str]) -> list[str]:
        out = [f"missing parameter {p}" for p in self.parameters if given.get(p) in (None, "")]
        ends = [given.get(k) for k in ("start_date", "end_date")]
        if any(ends):
            try:
                first, last = map(date.fromisoformat, ends)
                if first > last:
                    out.append("start_date must not follow end_date")
            except (TypeError, ValueError):
                out.append("start_date and end_date must both be dates like 2024-01-31")
        return out


def _table(text: str) -> dict[str, Manifest]:
    out = {}
    for line in text.strip().splitlines():
        name, what, requires, outputs, checks, priority, parameters = (x.strip() for x in line.split("|"))
        split = lambda s: tuple(s.split())
        out[name] = Manifest(name, what, split(requires), split(outputs), split(parameters), split(priority), split(checks))
    return out


# The built-in contracts: systems, outputs, checks, priority of systems, parameters.
BUILTIN = _table(
    """
    pipeline_health | lead flow, opportunities and pipeline | crm | leads opportunities pipeline_amount closed_won_revenue | missing_crm_mapping | crm | client_id start_date end_date
    reach_historical | paid reach against leads | ads crm | spend reach impressions clicks conversions conversion_value conversion_rate leads | crm_vs_ad_leads | crm ads | client_id start_date end_date
    weekly_gtm_review | weekly review across channels | crm ads | spend reach conversions leads opportunities pipeline_amount | crm_vs_ad_leads | crm ads | client_id start_date end_date
    website_performance | web traffic and conversions | analytics | sessions active_users total_users event_count key_events conversions revenue engagement_rate conversion_rate | | analytics | client_id start_date end_date
    traffic_attribution_check | paid traffic against sessions | ads analytics | spend impressions clicks sessions active_users conversions key_events conversion_value revenue conversion_rate | ads_vs_analytics_conversions ad_spend_without_sessions | analytics ads | client_id start_date end_date
    full_gtm_signal_check | all three systems | crm ads analytics | spend clicks sessions conversions key_events leads opportunities pipeline_amount closed_won_revenue | crm_vs_ad_leads ads_vs_analytics_conversions analytics_vs_crm_leads ad_spend_without_sessions | crm analytics ads | client_id start_date end_date
    warehouse_segment_size_preview | segment size and hygiene | warehouse | contacts accounts segment_size suppressed_count missing_email_count stale_record_count | suppression_warning | warehouse | client_id
    warehouse_buyer_signal_rollup | buyer signals | warehouse | buyer_signal_count avg_signal_strength accounts contacts | | warehouse | client_id start_date end_date
    warehouse_suppression_check | suppression before activation | warehouse | contacts suppressed_count missing_email_count | suppression_warning | warehouse | client_id
    warehouse_campaign_outcome_rollup | campaign outcomes | warehouse | leads opportunities pipeline_amount closed_won_revenue conversion_rate | | warehouse | client_id start_date end_date
    """
)


@dataclass
class Client:
    """A client's configuration: the providers of each kind of system, field maps, and its status."""

    client_id: str
    systems: dict[str, list[str]]
    field_map: dict[str, dict[str, str]] = field(default_factory=dict)
    metrics: dict[str, dict] = field(default_factory=dict)
    status: str = "active"
    read_only: bool = True

    def errors(self, known: set[str]) -> list[str]:
        out = [] if self.client_id else ["client_id is required"]
        out += [] if self.read_only else ["clients are read-only"]
        out += [f"unknown provider {p}" for ps in self.systems.values() for p in ps if p not in known]
        for name, fields in self.field_map.items():
            if name not in OBJECT_FIELDS:
                out.append(f"unknown object {name}")
            else:
                out += [f"{name} lacks field {f}" for f in OBJECT_FIELDS[name] if f not in fields]
        return out + [f"unknown metric {m}" for m in self.metrics if m not in METRICS]


def missing_fields(mapped: DataFrame, required: dict[str, tuple[str, ...]] = OBJECT_FIELDS) -> DataFrame:
    """(client_id, object, field, problem) of field maps (client_id, object, field): unknown objects, and required fields not mapped."""
    spark = mapped.sparkSession
    need = spark.createDataFrame([(o, f) for o, fs in required.items() for f in fs], "object string, field string")
    objects = mapped.select("client_id", "object").distinct()
    known = need.select("object").distinct()
    odd = objects.join(known, "object", "left_anti").select("client_id", "object", F.lit("").alias("field"), F.lit("unknown object").alias("problem"))
    lack = objects.join(need, "object").join(mapped, ["client_id", "object", "field"], "left_anti")
    return odd.unionByName(lack.select("client_id", "object", "field", F.lit("missing field").alias("problem")))


CLIENT = "client_id string, systems map<string,array<string>>, field_map map<string,map<string,string>>, metrics map<string,string>, status string, read_only boolean"


def save_clients(spark: SparkSession, clients: list[Client], path: str) -> None:
    """Write clients, which are configuration, as one small table, definitions of metrics as JSON; ids must be unique."""
    ids = [c.client_id for c in clients]
    if len(set(ids)) < len(ids):
        raise ValueError("client ids must be unique")
    rows = [(c.client_id, c.systems, c.field_map, {m: json.dumps(d, sort_keys=True) for m, d in c.metrics.items()}, c.status, c.read_only) for c in clients]
    spark.createDataFrame(rows, CLIENT).write.mode("overwrite").json(path)


def load_clients(spark: SparkSession, path: str) -> list[Client]:
    rows = spark.read.schema(CLIENT).json(path).orderBy("client_id").collect()
    return [Client(r.client_id, r.systems, r.field_map or {}, {m: json.loads(d) for m, d in (r.metrics or {}).items()}, r.status, r.read_only) for r in rows]


def refreshed(card: DataFrame, clients: list[Client], connectors: dict[str, Connector], fresh_at: str) -> DataFrame:
    """A new card for one stored card (query_id, client_id, parameters): its contract is run again with its own parameters."""
    old = card.select("query_id", "client_id", "parameters").first()
    only = [c for c in clients if c.client_id == old.client_id]
    rows, _ = run(BUILTIN[old.query_id], only, connectors, old.parameters)
    return evidence_cards(BUILTIN[old.query_id], rows, fresh_at, parameters=old.parameters)


def run(manifest: Manifest, clients: list[Client], connectors: dict[str, Connector], parameters: dict[str, str], collect_errors: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Long metrics (client_id, kind, provider, metric, value) of all clients as one plan, and the clients' errors.

    Nothing runs here: each provider is read once for all its clients, and the rows are unioned.
    """
    failed: dict[str, str] = {}
    if bad := manifest.errors():
        raise ValueError("; ".join(bad))
    by_provider: dict[tuple[str, str], list[str]] = {}
    for c in clients:
        if c.status == "archived":
            continue
        errors = manifest.parameter_errors({"client_id": c.client_id} | parameters) + c.errors(set(connectors))
        errors += [f"no {kind} system" for kind in manifest.requires if not c.systems.get(kind)]
        if errors:
            if not collect_errors:
                raise ValueError(f"{c.client_id}: {'; '.join(errors)}")
            failed[c.client_id] = "; ".join(errors)
            continue
        for kind in manifest.requires:
            for p in c.systems[kind]:
                by_provider.setdefault((kind, p), []).append(c.client_id)
    out = None
    for (kind, provider), ids in sorted(by_provider.items()):
        wide = connectors[provider].metrics(parameters).where(F.col("client_id").isin(ids))
        kept = [c for c in wide.columns if c in manifest.outputs]
        rows = wide.select("client_id", F.lit(kind).alias("kind"), F.lit(provider).alias("provider"), *kept).unpivot(
            ["client_id", "kind", "provider"], kept, "metric", "value"
        )
        rows = rows.withColumn("value", F.col("value").cast("double"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no client can run")
    return out, failed


def evidence_cards(manifest: Manifest, metrics: DataFrame, fresh_at: str, partial: bool = False, parameters: dict[str, str] | None = None) -> DataFrame:
    """One card for each client: id, selected metrics with their providers, conflicts, quality, score and the run's parameters."""
    chosen = V.selected_metrics(metrics, list(manifest.source_priority))
    body = chosen.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("metric", "value", "provider"))).alias("metrics"))
    found = V.reconcile(metrics).where(F.col("conflict_type").isin(*manifest.conflict_checks or [""])).withColumn("status", F.lit("open"))
    conflicts = found.groupBy("client_id").agg(F.array_sort(F.collect_list("conflict_type")).alias("conflicts"))
    clients = body.select("client_id", F.lit(partial).alias("partial"))
    cards = body.join(conflicts, "client_id", "left").join(V.data_quality(found, clients), "client_id")
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(manifest.id), "client_id", F.lit(fresh_at), F.to_json("metrics")), 256), 1, 16)
    return cards.select(
        F.concat_ws(":", F.lit("ev"), F.lit(manifest.id), "client_id", digest).alias("evidence_id"),
        "client_id", F.lit(manifest.id).alias("query_id"), F.lit(fresh_at).cast("timestamp").alias("fresh_at"),
        "metrics", F.coalesce("conflicts", F.array().cast("array<string>")).alias("conflicts"), "quality", "score",
        F.create_map(*(F.lit(x) for kv in sorted((parameters or {}).items()) for x in kv)).cast("map<string,string>").alias("parameters"),
    )
