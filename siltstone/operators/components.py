"""Connected components of links, and joins that keep hot keys out of single tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def hottest_keys(rows: DataFrame, key: str, hottest: int = 1000) -> DataFrame:
    """The keys of most rows, ``hottest`` of them; counts combine in the tasks before they move."""
    return rows.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(hottest).select(key)


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, hottest: int = 1000, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` with the ``value`` that ``table`` (unique ``key``, ``value``) has for their key; null where it has none.

    The ``hottest`` keys of the rows, or those of ``hot`` where they are known, are broadcast, the others joined: none of these holds more than
    one in ``hottest`` of the rows.
    """
    hot = (hottest_keys(rows, key, hottest) if hot is None else hot).select(F.col(key).alias("_hot"))
    held = table.join(F.broadcast(hot), F.col(key) == F.col("_hot")).select(F.col(key).alias("_held"), F.col(value).alias("_hot_value"))
    known = hot.join(F.broadcast(held), F.col("_hot") == F.col("_held"), "left").select("_hot", "_hot_value")
    marked = rows.join(F.broadcast(known), F.col(key) == F.col("_hot"), "left")
    found = marked.where("_hot IS NOT NULL").select(*rows.columns, F.col("_hot_value").alias(value))
    rest = marked.where("_hot IS NULL").select(*rows.columns).join(table.select(key, value).hint("merge"), key, "left")
    return found.unionByName(rest.select(*rows.columns, value))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each end of a link is connected with, over any number of links.

    Every round each vertex takes the name of the least of itself and its neighbours, by a hash of the ids, and links are renamed.
    Vertices that share a name become one, so their number shrinks by a constant factor; a star is gone after two rounds, whatever its
    size. The names of all rounds are joined from the last to the first. Null ends link nothing, nor do links of an id with itself
    but for making it known.
    """
    both = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct(), "ends")
    ids = both.select("x").unionByName(both.select(F.col("y").alias("x"))).distinct().select(F.col("x").alias("id"))
    edges = both.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    named = []
    while not edges.isEmpty():
        each = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        least = each.groupBy("x").agg(F.min(rank("y")).alias("near"), F.count("*").alias("degree"))
        names = written(least.select("x", F.least(rank("x"), F.col("near"))["v"].alias("name"), "degree"), "names")
        hubs = written(names.orderBy(F.desc("degree"), "x").limit(1000).select("x"), "hubs")
        named.append(names.select("x", "name"))
        first = looked_up(edges, names, "x", "name", hot=hubs).select(F.col("name").alias("p"), F.col("y").alias("x"))
        second = looked_up(first, names, "x", "name", hot=hubs).where("p != name")
        edges = written(second.select(F.least("p", "name").alias("x"), F.greatest("p", "name").alias("y")).distinct(), "links")
    if not named:
        return ids.select("id", F.col("id").alias("component"))
    root = named.pop().withColumnRenamed("name", "root")
    while named:  # names of a round are vertices of the next; those that were alone there stay
        below = named.pop().select(F.col("x").alias("id"), F.col("name").alias("x"))
        root = looked_up(below, root, "x", "root").select(F.col("id").alias("x"), F.coalesce("root", "x").alias("root"))
    root = written(root, "roots")
    smallest = root.groupBy("root").agg(F.min("x").alias("component"))
    known = looked_up(root, smallest, "root", "component").select(F.col("x").alias("id"), "component")
    return ids.join(known.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
