"""Claims, duplicates, contradictions, conflicts and the audit ledger of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written
from .components import components, looked_up
from .matching import block_ratio, close_counts, matching_texts

UNRESOLVED = ("open", "acknowledged")


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def open_conflicts_for(refs: DataFrame, conflicts: DataFrame, by: str, most: int = 5) -> DataFrame:
    """The worst unresolved conflicts of the objects (object_type, object_id) that each ``by`` refers to."""
    live = conflicts.where(F.col("status").isin(*UNRESOLVED))
    found = refs.join(live, ["object_type", "object_id"]).dropDuplicates([by, "conflict_id"])
    w = Window.partitionBy(by).orderBy(severity_rank(F.col("severity")), F.col("conflict_id").desc())
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def claim_records(nodes: DataFrame) -> DataFrame:
    """Claims of live nodes (id, type, name, summary, status): text, normal form, subject and polarity."""
    text = F.col("claim_text")
    found = nodes.where(T.is_live(F.col("status"))).withColumn("claim_text", T.claim_text(F.col("type"), F.col("name"), F.col("summary")))
    return (
        found.where("claim_text != ''")
        .withColumn("subject_key", T.subject_key(text))
        .where("subject_key != ''")
        .select(
            T.stable_id("claimrec", F.col("id"), F.substring(T.normalize_text(text), 1, 400)).alias("claim_id"),
            F.col("id").alias("node_id"),
            "claim_text",
            "subject_key",
            T.polarity(text).alias("polarity"),
            "status",
        )
    )


def claim_classes(claims: DataFrame) -> DataFrame:
    """Claims that say the same of a subject are one class: its smallest claim and node stand for it."""
    return claims.groupBy("subject_key", "polarity", T.normalize_text(F.col("claim_text")).alias("said")).agg(
        F.min_by("claim_id", "node_id").alias("claim_id"), F.min("node_id").alias("node_id"), F.count("*").alias("size")
    )


def contradictions(claims: DataFrame) -> DataFrame:
    """Pairs of claim classes on one subject with opposite polarity, with the classes' sizes.

    The positive side is joined to the negative one, so a pair is found once and none within a side is formed;
    copies of a claim are members of its class (``claim_classes``) and never multiply pairs.
    """
    classes = claim_classes(claims)
    side = lambda p, x: classes.where(F.col("polarity") == p).select(
        "subject_key", F.col("claim_id").alias(f"{x}_claim"), F.col("node_id").alias(f"{x}_node"), F.col("size").alias(f"{x}_size")
    )
    return side("positive", "pos").join(side("negative", "neg"), "subject_key").where("pos_node != neg_node")


def item_key(*items: Column) -> Column:
    """The sorted items of a conflict, each as type:id:role."""
    return F.array_join(F.array_sort(F.array(*items)), "|")


def conflict_id(kind: Column, *items: Column) -> Column:
    return F.concat(F.lit("conflict:"), kind, F.lit(":"), F.substring(F.sha1(item_key(*items)), 1, 16))


def duplicate_groups(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Rows that share a key, as (key, keep_id, id): every other row points to the group's smallest id.

    A group of n rows gives n - 1 links instead of n(n-1)/2 pairs; every pair follows from them.
    """
    keyed = rows.select(key.alias("key"), F.col(id_col).alias("id")).where("key is not null")
    first = keyed.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, "key").where("id != keep_id").select("key", "keep_id", "id")


def similar_titles(sources: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Links of sources of one type whose normalised titles are close: the ratio of matching blocks, in either order, reaches the threshold.

    Sources with one title are linked to the smallest id among them; close titles link these ids, so equal titles
    never multiply pairs.
    """
    t = sources.select("id", "source_type", T.normalize_name(F.col("title")).alias("text")).where("text != ''")
    first = t.groupBy("source_type", "text").agg(F.min("id").alias("first"))
    same = t.join(first, ["source_type", "text"]).where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = matching_texts(first, first, threshold, ["source_type"]).where("left != right")
    side = lambda key, x: first.select("source_type", F.col("text").alias(key), F.col("first").alias(x))
    found = near.join(side("left", "x"), ["source_type", "left"]).join(side("right", "y"), ["source_type", "right"])
    return same.unionByName(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def duplicate_sources(sources: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Links of visible sources with one canonical address, or of one type with close titles: (a, b, exact_url)."""
    live = sources.where(F.col("status").isin("active", "stale_pending_refresh"))
    url = duplicate_groups(live, T.canonical_url(F.col("url")), "id")
    exact = url.select(F.least("keep_id", "id").alias("a"), F.greatest("keep_id", "id").alias("b"), F.lit(True).alias("exact_url"))
    close = similar_titles(live, threshold).select("a", "b", F.lit(False).alias("exact_url"))
    return exact.unionByName(close).groupBy("a", "b").agg(F.max("exact_url").alias("exact_url"))


def duplicate_entities(nodes: DataFrame, aliases: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Links (keep_id, id) of live nodes of one type that share a normalised name or alias, or whose names are close.

    Nodes with one name or alias are linked to the smallest id among them. Names are close when the ratio of matching blocks
    reaches the threshold, the name of the smaller id first; they link the smallest ids that bear them.
    """
    same, borne = _names_borne(nodes, aliases)
    near = matching_texts(borne, borne, threshold, ["type"]).where("left != right")
    side = lambda key, x: borne.select("type", F.col("text").alias(key), F.col("first").alias(x), F.col("last").alias(f"{x}_last")).hint("merge")
    found = near.join(side("left", "x"), ["type", "left"]).join(side("right", "y"), ["type", "right"]).where("x < y_last")  # a smaller id bears the left name
    return same.unionByName(found.select(F.least("x", "y").alias("keep_id"), F.greatest("x", "y").alias("id"))).distinct()


def _names_borne(nodes: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (keep_id, id) of live nodes of one type with one normalised name or alias; names (type, text, first, last), written, with the first and last id that bears them."""
    live = nodes.where(T.is_live(F.col("status")))
    names = live.select("id", "type", T.normalize_name(F.col("name")).alias("key"))
    more = live.join(aliases.hint("merge"), live["id"] == aliases["node_id"]).select("id", "type", T.normalize_name(F.col("alias")).alias("key"))
    keyed = names.unionByName(more).where("key != ''").distinct()
    same = duplicate_groups(keyed, F.concat_ws("|", "type", "key"), "id").select("keep_id", "id")
    borne = names.where("key != ''").groupBy("type", F.col("key").alias("text")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return same, written(borne, "names")


def entity_classes(nodes: DataFrame, aliases: DataFrame, threshold: float = 0.90) -> DataFrame:
    """The ``linked_classes`` of ``duplicate_entities``, without a row for each close pair: numbered names have hundreds of close ones each.

    Close names are counted where they meet. Links by an equal name or alias that close names give once more count once.
    """
    same, borne = _names_borne(nodes, aliases)
    if not borne.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # an id with several names, whose pairs may give one link twice
        return linked_classes(duplicate_entities(nodes, aliases, threshold))
    same = written(same.distinct(), "same")
    n_close, chains = close_counts(borne, threshold, ["type"])
    side = lambda x: borne.select(F.col("first").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("type", "text", "last"))).hint("merge")
    both = same.join(side("keep_id"), "keep_id").join(side("id"), "id").where("keep_id_type = id_type AND keep_id_text != id_text")
    ratio = F.pandas_udf(block_ratio, "double").asNondeterministic()
    both = both.withColumns({"ahead": ratio("keep_id_text", "id_text"), "back": ratio("id_text", "keep_id_text")})
    twice = both.where((F.col("ahead") >= threshold) | (F.col("id") < F.col("keep_id_last")) & (F.col("back") >= threshold)).select("keep_id", "id")
    ends = lambda links, k: links.select(F.explode(F.array("keep_id", "id")).alias("id"), F.lit(k).cast("long").alias("n"))
    n = ends(same, 1).unionByName(ends(twice, -1)).unionByName(n_close).groupBy("id").agg(F.sum("n").alias("n_links"))
    links = same.select(F.col("keep_id").alias("a"), F.col("id").alias("b")).unionByName(chains)
    return components(links).withColumnRenamed("component", "component_id").join(n.hint("merge"), "id")


def linked_classes(links: DataFrame, a: str = "keep_id", b: str = "id") -> DataFrame:
    """(id, component_id, n_links): one row for each id that a link names, with the smallest id it is connected with."""
    links = written(links.select(a, b), "class-links")
    ends = links.select(F.col(a).alias("id")).unionByName(links.select(F.col(b).alias("id")))
    n = ends.groupBy("id").agg(F.count("*").alias("n_links"))
    return components(links, a, b).withColumnRenamed("component", "component_id").join(n.hint("merge"), "id")


# --- changes ---------------------------------------------------------------------------------------------------


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``incoming`` replace those with the same keys (null equals null); of several the last in order.

    Without an order, the last is the one whose values, read as JSON, are the greatest. ``keep`` names columns whose stored
    value survives a conflict.
    """
    last = order or [F.to_json(F.struct(*(c for c in current.columns if c not in keys)))]
    rank = Window.partitionBy(*keys).orderBy(*[c.desc() for c in last])
    new = incoming.withColumn("_rn", F.row_number().over(rank)).where("_rn = 1").drop("_rn")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    both = current.withColumn("_c", F.lit(True)).alias("c").join(new.withColumn("_i", F.lit(True)).alias("i"), same, "full")
    pick = lambda c: (
        F.when(F.col("_c") & F.lit(c in (keep or [])), F.col(f"c.{c}")).when(F.col("_i"), F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
    )
    return both.select(*(pick(c) for c in current.columns))


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose keys are not there yet are added."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current, keys, "left_anti").select(*current.columns))


def replace_by_key(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of a key are replaced by those of ``incoming`` (a document's chunks, for example)."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def upsert_nodes(state: dict[str, DataFrame], incoming: dict[str, DataFrame], keep: list[str] | None = None) -> dict[str, DataFrame]:
    """Nodes upserted by id; the aliases and tags of every incoming node are rewritten, also where it brings none."""
    ids = incoming["nodes"].select(F.col("id").alias("node_id"))
    out = {"nodes": upsert(state["nodes"], incoming["nodes"], ["id"], keep=keep)}
    for name in ("aliases", "tags"):
        left = without_keys(state[name], ids, "node_id")
        out[name] = left.unionByName(only_keys(incoming[name], ids, "node_id")).distinct() if name in incoming else left
    return out


def only_keys(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the chosen ones."""
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def with_counts(rows: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows with the number of their children; those without any have 0."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return rows.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def with_details(rows: DataFrame, children: DataFrame, key: str, order: str) -> DataFrame:
    """Objects with their children's number and ``order`` values, ascending; objects without children have none."""
    held = children.groupBy(key).agg(F.count("*").alias("items"), F.array_sort(F.collect_list(order)).alias("details"))
    return rows.join(held, key, "left").withColumns({"items": F.coalesce("items", F.lit(0)).cast("long"), "details": F.coalesce("details", F.array())})


def listed(rows: DataFrame, order: list[Column], limit: int, where: Column | None = None) -> DataFrame:
    """The first rows of a filtered listing; the last key in the order should be unique."""
    return (rows.where(where) if where is not None else rows).orderBy(*order).limit(limit)


def conflict_listing(conflicts: DataFrame, by: str) -> DataFrame:
    """Unresolved conflicts with their place in each list: worst first, then newest."""
    w = Window.partitionBy(by).orderBy(severity_rank(F.col("severity")), F.desc("conflict_id"))
    return conflicts.where(F.col("status").isin(*UNRESOLVED)).withColumn("pos", F.row_number().over(w))


def table_counts(tables: dict[str, DataFrame], by: dict[str, Column] | None = None) -> DataFrame:
    """(name, n) of several tables; with ``by``, an owner for each table, (client_id, name, n)."""
    out = None
    for name, df in tables.items():
        keys = [by[name].alias("client_id")] if by else []
        one = df.groupBy(*keys).agg(F.count("*").alias("n")).select(*(["client_id"] if by else []), F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both sides hold, once each."""
    return left.select(*keys).intersect(right.select(*keys))


def changed_objects(items: DataFrame, by: str, key: str) -> DataFrame:
    """The distinct objects of each change set."""
    return items.select(by, key).distinct()


def without_keys(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key).distinct(), key, "left_anti")


def change_items(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action, before, after): what differs between two states; images are null where a row is absent."""
    image = lambda side: F.to_json(F.struct(*(F.col(f"{side}.{c}").alias(c) for c in columns)))
    b, a = before.withColumn("_b", F.lit(True)).alias("b"), after.withColumn("_a", F.lit(True)).alias("a")
    both = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "full").select(
        F.coalesce(f"b.{key}", f"a.{key}").alias(key), F.when(F.col("_b"), image("b")).alias("before"), F.when(F.col("_a"), image("a")).alias("after")
    )
    action = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("action", action)


def set_status(rows: DataFrame, chosen: DataFrame, key: str, status: str) -> DataFrame:
    """Rows whose key is chosen get a status; the others stay."""
    mark = chosen.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(mark, key, "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit").select(*rows.columns)


def rollback_conflicts(current: DataFrame, items: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Objects whose state is no longer the change set's after image; a rollback needs force for these."""
    now = current.select(key, F.to_json(F.struct(*columns)).alias("now"))
    return items.join(now, key, "left").where(~F.col("now").eqNullSafe(F.col("after"))).select(key, "after", "now")


def rolled_back(current: DataFrame, items: DataFrame, key: str, schema: str) -> DataFrame:
    """Current rows with every change undone: before images restored, created rows marked reverted."""
    image = F.from_json("before", schema)
    joined = current.join(items.select(key, "before", F.lit(True).alias("_hit")), key, "left").withColumn("_image", image)
    restored = lambda c: (
        F.when(F.col("before").isNotNull(), F.col(f"_image.{c}")).when(F.col("_hit") & F.lit(c == "status"), F.lit("reverted")).otherwise(F.col(c)).alias(c)
    )
    return joined.select(*(F.col(c) if c == key else restored(c) for c in current.columns))


def merged_aliases(nodes: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """(keep_id, aliases): the smallest node of each component of links takes over ids, names and aliases of the others, sorted."""
    keep = components(links, "keep_id", "id").where("id != component").withColumnRenamed("component", "keep_id")
    return _taken_over(nodes, aliases, keep).groupBy("keep_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def _taken_over(nodes: DataFrame, aliases: DataFrame, keep: DataFrame) -> DataFrame:
    """(keep_id, alias): ids, names and aliases of the nodes of ``keep`` (id, keep_id) that go to others."""
    own = nodes.select("id", F.explode(F.array("id", "name")).alias("alias"))
    known = looked_up(aliases.select(F.col("node_id").alias("id"), "alias"), keep, "id", "keep_id")
    return own.join(keep, "id").select("keep_id", "alias").unionByName(known.where("keep_id IS NOT NULL").select("keep_id", "alias")).where("alias != ''").distinct()


CANONICAL_TAG = "dedupe-canonical"


def merge_duplicates(state: dict[str, DataFrame], links: DataFrame, conflicts: DataFrame | None = None, chosen: DataFrame | None = None) -> dict[str, DataFrame]:
    """The state after all nodes of each component of ``links`` (keep_id, id) are merged into one.

    ``state`` has nodes, aliases (node_id, alias) and tags (node_id, tag). Of a component the smallest id stays, or the smallest of
    ``chosen`` (id) in it; ids that are no nodes link others but are not merged. The node that stays gets the ids, names and aliases of the
    others and the tag ``dedupe-canonical``; the others get the status merged and keep their rows. ``conflicts`` (conflict_id,
    conflict_type, keep_id, id, status) between duplicates of one component are resolved. ``changes`` has a row for each node, alias and tag that
    changed: object_type, object_id, operation, before, after. Aliases stay rows, so a node may take over any number of them.
    """
    nodes, aliases, tags = (state[k] for k in ("nodes", "aliases", "tags"))
    classes = components(links, "keep_id", "id").join(nodes.select("id"), "id", "left_semi")
    preferred = F.min(F.when(F.col("wanted"), F.col("id")))
    wanted = classes.join(chosen.select("id", F.lit(True).alias("wanted")).distinct(), "id", "left") if chosen is not None else classes.withColumn("wanted", F.lit(None).cast("boolean"))
    first = wanted.groupBy("component").agg(F.coalesce(preferred, F.min("id")).alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    members = written(looked_up(classes, first, "component", "keep_id").where("keep_id IS NOT NULL").select("id", "keep_id"), "members")
    gone = members.where("id != keep_id")
    new_aliases = _taken_over(nodes, aliases, gone).select(F.col("keep_id").alias("node_id"), "alias").join(aliases, ["node_id", "alias"], "left_anti")
    stays = members.where("id = keep_id").select(F.col("id").alias("node_id"), F.lit(CANONICAL_TAG).alias("tag"))
    new_tags = stays.join(tags, ["node_id", "tag"], "left_anti")
    row = lambda kind, operation, before, after: (F.lit(kind).alias("object_type"), "object_id", F.lit(operation).alias("operation"), before.alias("before"), after.alias("after"))
    none = F.lit(None).cast("string")
    merged = nodes.join(gone, "id").where("status != 'merged'").withColumnRenamed("id", "object_id")
    changes = (
        merged.select(*row("node", "dedupe:merge", F.col("status"), F.lit("merged")))
        .unionByName(new_aliases.withColumnRenamed("node_id", "object_id").select(*row("alias", "dedupe:canonicalize", none, F.col("alias"))))
        .unionByName(new_tags.withColumnRenamed("node_id", "object_id").select(*row("tag", "dedupe:canonicalize", none, F.col("tag"))))
    )
    out = {
        "nodes": set_status(nodes, gone, "id", "merged"),
        "aliases": aliases.unionByName(new_aliases.select(*aliases.columns)),
        "tags": tags.unionByName(new_tags.select(*tags.columns)),
        "changes": changes,
        "members": members,
    }
    if conflicts is not None:
        of = lambda c, x: members.select(F.col("id").alias(c), F.col("keep_id").alias(x))
        held = looked_up(looked_up(conflicts, of("keep_id", "_left"), "keep_id", "_left"), of("id", "canonical_id"), "id", "canonical_id")
        done = (F.col("conflict_type") == "duplicate_entity") & F.col("status").isin(*UNRESOLVED) & (F.col("_left") == F.col("canonical_id"))
        held = held.withColumn("_done", F.coalesce(done, F.lit(False)))
        out["conflicts"] = held.select(
            *(F.when(F.col("_done"), F.lit("resolved")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in conflicts.columns),
            F.when(F.col("_done"), F.lit("merge_entities")).alias("resolution"),
            F.when(F.col("_done"), F.col("canonical_id")).alias("canonical_id"),
        )
    return out


def split_duplicates(state: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """The state before a merge, from the state after it and its changes; resolved conflicts of the merge are open again."""
    of = lambda kind, key, value: changes.where(F.col("object_type") == kind).select(F.col("object_id").alias(key), F.col("after").alias(value))
    old = changes.where("object_type = 'node'").select(F.col("object_id").alias("id"), F.col("before").alias("_before"))
    nodes = state["nodes"]
    out = {
        "nodes": nodes.join(old, "id", "left").withColumn("status", F.coalesce("_before", "status")).select(*nodes.columns),
        "aliases": state["aliases"].join(of("alias", "node_id", "alias"), ["node_id", "alias"], "left_anti").select(*state["aliases"].columns),
        "tags": state["tags"].join(of("tag", "node_id", "tag"), ["node_id", "tag"], "left_anti").select(*state["tags"].columns),
    }
    if "conflicts" in state:
        again = F.col("resolution").eqNullSafe("merge_entities")
        kept = [c for c in state["conflicts"].columns if c not in ("resolution", "canonical_id")]
        out["conflicts"] = state["conflicts"].select(*(F.when(again, F.lit("open")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in kept))
    return out


def recorded_conflicts(current: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """Found conflicts against the ledger: unresolved ones are updated, resolved ones recur under a new id."""
    old = current.select(F.col("conflict_id").alias("base_id"), F.col("status").alias("old_status"))
    rows = found.withColumnRenamed("conflict_id", "base_id").join(old, "base_id", "left")
    again = F.col("old_status").isNotNull() & ~F.col("old_status").isin(*UNRESOLVED)
    kind = F.regexp_replace("base_id", ":[0-9a-f]{16}$", "")
    fresh = F.concat(kind, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", "base_id", F.lit("recurrence"), F.lit(now))), 1, 16))
    return rows.select(
        F.when(again, fresh).otherwise(F.col("base_id")).alias("conflict_id"),
        F.when(again | F.col("old_status").isNull(), F.lit("open")).otherwise(F.col("old_status")).alias("status"),
        F.when(again, F.col("base_id")).alias("previous_conflict_id"),
    )


def is_stale(checked: Column, window_days: Column, now: Column) -> Column:
    """Never checked, or the window has passed at ``now`` (the bound itself is stale)."""
    return checked.isNull() | (checked + F.make_dt_interval(window_days) <= now)


def refresh_candidates(sources: DataFrame, now: Column, limit: int) -> DataFrame:
    """Visible sources, never checked first, then the oldest; the limit comes before the staleness test."""
    visible = sources.where(F.col("status").isin("active", "stale_pending_refresh"))
    first = visible.orderBy(F.col("last_checked_at").asc_nulls_first(), "title", "id").limit(limit)
    return first.where(is_stale(F.col("last_checked_at"), F.col("freshness_window_days"), now))


def owner_of(source_id: Column, part: int = 4) -> Column:
    """The client in a derived source id: its fourth part between colons."""
    return F.get(F.split(source_id, ":"), part - 1)


def apply_proposal(
    state: dict[str, DataFrame], proposal: dict[str, DataFrame], risk: str = "medium", allow_high_risk: bool = False
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The state (nodes, edges, evidence) after a proposal, and the change items of each table.

    High risk needs to be allowed; edges whose ends are neither in the state nor in the proposal are refused.
    Evidence comes before nodes and nodes before edges, whose key holds its evidence, null or not.
    """
    from .graph import missing_nodes

    if risk == "high" and not allow_high_risk:
        raise PermissionError("a high-risk proposal needs to be allowed")
    known = state["nodes"].select("id").unionByName(proposal["nodes"].select("id"))
    lacking = [r[0] for r in missing_nodes(proposal["edges"], known).orderBy("id").limit(20).collect()]
    if lacking:
        raise ValueError(f"edges refer to unknown nodes: {', '.join(lacking)}")
    keys = {"evidence": ["id"], "nodes": ["id"], "edges": ["source_id", "relation", "target_id", "evidence_id"]}
    after, items = dict(state), {}
    for name, key in keys.items():
        if name not in proposal:
            continue
        after[name] = upsert(state[name], proposal[name], key)
        named = lambda df, key=key: df.withColumn("_key", F.concat_ws("|", *(F.coalesce(F.col(k), F.lit("")) for k in key)))
        items[name] = change_items(named(state[name]), named(after[name]), "_key", state[name].columns)
    return after, items


def split_merged(nodes: DataFrame, conflicts: DataFrame, items: DataFrame, schema: str, conflict_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undo a merge: its changes are rolled back and its conflicts are open again."""
    return rolled_back(nodes, items, "id", schema), set_status(conflicts, conflict_ids, "conflict_id", "open")
