"""Definitions that include one another: chains, merged attributes, names across platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.session import settle


def chains(defs: DataFrame, key: str, includes: str) -> DataFrame:
    """(leaf, node, depth): every definition that each one reaches along its array of included ones, at its least depth.

    A definition that includes itself, directly or not, is reached once. Names that no definition has lead nowhere.
    """
    links = settle(defs.select(F.col(key).alias("_from"), F.explode(includes).alias("_to")).distinct())
    reached = settle(defs.select(F.col(key).alias("leaf"), F.col(key).alias("node")).distinct().withColumn("depth", F.lit(0)))
    frontier, depth = reached, 0
    while True:
        depth += 1
        ahead = frontier.join(links, frontier.node == links["_from"]).select("leaf", F.col("_to").alias("node")).distinct()
        frontier = settle(ahead.join(reached.select("leaf", "node"), ["leaf", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            return reached
        reached = settle(reached.unionByName(frontier))


def merged(defs: DataFrame, key: str, includes: str, name: str, attributes: list[str]) -> DataFrame:
    """(leaf, name, attributes...): each named table of a definition and of all it includes, each attribute from the nearest
    definition that gives it. Of definitions at one depth the least key counts. defs has a row for each definition and table."""
    reach = chains(defs.select(key, includes).distinct(), key, includes)
    rows = reach.join(defs.select(F.col(key).alias("node"), name, *attributes).where(F.col(name).isNotNull()), "node")
    place = F.struct("depth", "node")
    return rows.groupBy("leaf", name).agg(*(F.min_by(a, F.when(F.col(a).isNotNull(), place)).alias(a) for a in attributes))


def platform_name(semantic: Column, names: dict[str, str]) -> Column:
    """A platform's name of a table; null where the platform has no such table."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), semantic)


def semantic_id(name: Column, names: dict[str, str], variants: dict[str, list[str]] | None = None) -> Column:
    """What a platform's name, or a known variant of it, stands for; of several the first in the order of names."""
    known: dict[str, str] = {}
    for meaning, primary in names.items():
        for n in (primary, *(variants or {}).get(meaning, ())):
            known.setdefault(n, meaning)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), name)
