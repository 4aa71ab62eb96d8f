"""Authority and governance: anchors, adjudication, policy, and the hash-chained ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship

# Statuses under which evidence is live.
LIVE = ("active", "accepted", "fresh", "ok", "not_required", "")


def matching_anchors(requests: DataFrame, anchors: DataFrame) -> DataFrame:
    """The anchor of each request: its scope (claim_type, client_id; ``*`` for any) holds, most specific first, then by id.

    Anchors are configuration and are broadcast, the first of each scope. A request looks up the four scopes that may hold it where it lies, so
    requests are neither shuffled nor sorted, however few types they have.
    """
    a = anchors.where("status = 'active'").withColumn(
        "specificity", (F.col("scope_claim_type") != "*").cast("int") + (F.col("scope_client_id") != "*").cast("int")
    )
    cols = [c for c in a.columns if c not in ("status",)]
    first = Window.partitionBy("scope_claim_type", "scope_client_id").orderBy("anchor_id")
    best = a.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    found = requests
    for name, typed, owned in (("both", True, True), ("typed", True, False), ("owned", False, True), ("any", False, False)):
        holds = [(F.col("scope_claim_type") != "*") if typed else (F.col("scope_claim_type") == "*"), (F.col("scope_client_id") != "*") if owned else (F.col("scope_client_id") == "*")]
        side = best.where(holds[0] & holds[1]).select(F.col("scope_claim_type").alias("_type"), F.col("scope_client_id").alias("_client"), F.struct(*cols).alias(f"_{name}"))
        met = [F.col("claim_type") == F.col("_type")] * typed + [F.col("client_id") == F.col("_client")] * owned
        found = found.join(F.broadcast(side), met or F.lit(True), "left").drop("_type", "_client")
    one = F.when(F.col("_owned").isNull() | (F.col("_typed.anchor_id") <= F.col("_owned.anchor_id")), F.col("_typed")).otherwise(F.col("_owned"))
    return found.withColumn("_anchor", F.coalesce("_both", one, "_any")).select(*requests.columns, *(F.col(f"_anchor.{c}") for c in cols))


def adjudicate(requests: DataFrame, anchors: DataFrame, now: Column) -> DataFrame:
    """(request_id, decision, anchor_id) of requests with source, evidence_id and fresh_at."""
    m = matching_anchors(requests, anchors)
    age = F.greatest((F.unix_micros(now) - F.unix_micros(F.col("fresh_at").cast("timestamp"))) / 3600e6, F.lit(0.0))
    stale = F.col("fresh_at").isNull() | (age > F.col("freshness_sla_hours"))
    strict = F.when(F.contains("conflict_behavior", F.lit("block")), "block").otherwise("warn")
    missing = F.array_contains("required_evidence", F.lit("evidence_id")) & (F.coalesce("evidence_id", F.lit("")) == "")
    decision = (
        F.when(F.col("anchor_id").isNull(), "unknown")
        .when(F.array_contains("forbidden_sources", F.col("source")), "block")
        .when(missing, strict)
        .when(F.col("source") == F.col("authoritative_source"), F.when(stale, "warn").otherwise("allow"))
        .when(F.array_contains("fallback_sources", F.col("source")), "warn")
        .otherwise(strict)
    )
    return m.select("request_id", decision.alias("decision"), "anchor_id")


def policy(rows: DataFrame) -> DataFrame:
    """(request_id, policy): the worst of what the evidence's state, its conflicts and the authority say.

    Columns: found, evidence_status, n_warnings, kind, resolution_status, n_entities, n_conflicts, authority.
    """
    c = F.col
    note = c("kind") == "evidence_annotation"
    steps = [
        F.when(~c("found"), "block").otherwise("allow"),
        F.when(c("found") & ~F.lower(T.text_or_empty("evidence_status")).isin(*LIVE), "warn").otherwise("allow"),
        F.when(c("found") & (c("n_warnings") > 0), "warn").otherwise("allow"),
        F.when(c("found") & note & (~F.coalesce("resolution_status", F.lit("")).isin("accepted", "active") | (c("n_entities") == 0)), "require_review").otherwise("allow"),
        F.when(c("authority") == "block", "block").when(c("authority").isin("warn", "unknown"), "warn").otherwise("allow"),
        F.when(c("n_conflicts") > 0, "warn").otherwise("allow"),
    ]
    return rows.select("request_id", T.worst_decision(*steps).alias("policy"))


def canonical_json(values: Column) -> Column:
    """A map of strings as JSON with sorted keys and no spaces; equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def canonical_hash(values: Column) -> Column:
    return F.sha2(canonical_json(values), 256)


def _linked(names: list[str], chain: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by chain and order; each takes the receipt before it, and only that is carried on."""
        at, seq, before = None, 0, ""
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, c) for c in chain)
                if key != at:
                    at, seq, before = key, int(row.last_seq), row.last_receipt
                seq += 1
                link = "|".join((row.event_type, row.actor, row.payload_hash, before))
                new = hashlib.sha256(link.encode()).hexdigest()
                out.append((*key, seq, row.event_type, row.actor, row.payload, row.payload_hash, before, new))
                before = new
            yield pd.DataFrame(out, columns=names)

    return run


def append_events(ledger: DataFrame, events: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """Receipts of new events (chain, event_type, actor, payload, order...) that go on where each chain of the ledger ends.

    A receipt depends on the one before, so a chain's new events pass through one task in order; nothing but the last receipt
    is held, and chains are spread over tasks. Events must have actors, types and payloads.
    """
    names = [chain, "seq", "event_type", "actor", "payload", "payload_hash", "previous_hash", "receipt_hash"]
    ends = ledger.groupBy(chain).agg(F.max(F.struct("seq", "receipt_hash")).alias("e")).select(chain, F.col("e.seq").alias("last_seq"), F.col("e.receipt_hash").alias("last_receipt"))
    rows = events.join(ends, chain, "left").withColumns(
        {"payload_hash": F.sha2("payload", 256), "last_seq": F.coalesce("last_seq", F.lit(0)).cast("long"), "last_receipt": F.coalesce("last_receipt", F.lit(""))}
    )
    kind = dict(events.dtypes)[chain]
    schema = f"{chain} {kind}, seq long, event_type string, actor string, payload string, payload_hash string, previous_hash string, receipt_hash string"
    return rows.repartition(chain).sortWithinPartitions(chain, *order).mapInPandas(_linked(names, [chain]), schema)


def export_gates(conflicts: DataFrame, checked: DataFrame, severity: str = "high", result: str = "error") -> DataFrame:
    """(gate, blocking, passes): unresolved conflicts of a severity or worse, and checks of a result or worse, each shut an export."""
    worse = {"high": ("high",), "medium": ("high", "medium"), "low": ("high", "medium", "low")}[severity]
    failing = {"error": ("error",), "warn": ("error", "warn")}[result]
    open_ = conflicts.agg(F.count_if(F.col("status").isin("open", "acknowledged") & F.col("severity").isin(*worse)).alias("blocking"))
    bad = checked.agg(F.count_if(F.col("result").isin(*failing)).alias("blocking"))
    one = lambda df, name: df.select(F.lit(name).alias("gate"), "blocking", (F.col("blocking") == 0).alias("passes"))
    return one(open_, "open_conflicts").unionByName(one(bad, "governance_checks"))


def require_open_gates(gates: DataFrame) -> None:
    """Raise unless every gate passes; a gate is one row."""
    shut = [f"{r.gate} ({r.blocking})" for r in gates.where("not passes").orderBy("gate").collect()]
    if shut:
        raise PermissionError(f"export refused: {', '.join(shut)}")


def receipt(event_type: Column, actor: Column, payload_hash: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", event_type, actor, payload_hash, previous), 256)


def verify_chain(events: DataFrame, chain: list[str]) -> DataFrame:
    """Links of a ledger (seq, event_type, actor, payload, payload_hash, previous_hash, receipt_hash) that do not hold.

    ``chain`` names the columns of one chain; the previous receipt is found by joining seq - 1, which needs no
    global order in one task.
    """
    before = events.select(*chain, (F.col("seq") + 1).alias("seq"), F.col("receipt_hash").alias("_before"))
    j = events.join(before, [*chain, "seq"], "left")
    return j.select(
        *chain, "seq",
        (F.sha2("payload", 256) != F.col("payload_hash")).alias("payload_mismatch"),
        (F.coalesce("_before", F.lit("")) != F.col("previous_hash")).alias("previous_mismatch"),
        (receipt(F.col("event_type"), F.col("actor"), F.col("payload_hash"), F.col("previous_hash")) != F.col("receipt_hash")).alias("receipt_mismatch"),
    )


def evidence_reference(refs: DataFrame, cards: DataFrame, graph: DataFrame, notes: DataFrame) -> DataFrame:
    """(evidence_id, store, status): the first of three stores that knows a reference, else missing."""
    side = lambda df, name: df.select(F.col("id").alias("evidence_id"), F.col("status").alias(f"_{name}"))
    j = refs.join(side(cards, "card"), "evidence_id", "left").join(side(graph, "graph"), "evidence_id", "left").join(side(notes, "note"), "evidence_id", "left")
    return j.select(
        "evidence_id",
        F.when(F.col("_card").isNotNull(), "evidence_card").when(F.col("_graph").isNotNull(), "graph_evidence").when(F.col("_note").isNotNull(), "evidence_annotation").otherwise("missing").alias("store"),
        F.coalesce("_card", "_graph", "_note", F.lit("missing")).alias("status"),
    )


def checks(*rows: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    """One row for each check (name, data, error condition, warning condition): error, warn or ok."""
    out = None
    for name, df, error, warn in rows:
        one = df.agg(F.count_if(error).alias("errors"), F.count_if(warn).alias("warnings")).select(
            F.lit(name).alias("check_name"), F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warn").otherwise("ok").alias("result"), "errors", "warnings"
        )
        out = one if out is None else out.unionByName(one)
    return out


ship(__name__)
