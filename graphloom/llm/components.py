"""Consolidating pairwise matches into groups: connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # a hub's rows are the streamed side, so skewed partitions of this join can be split; the other has one row a node
    return both.where("v > u").join(least, "u").selectExpr("v as a", "m as b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below u are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").selectExpr("b as a", "m as b")
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """id, group_id: every id of the pairs with the least id (in the type's order) linked to it directly or not.

    Direction, repeated pairs and pairs with a null are of no effect; a pair of an id with itself gives a group of
    one. An empty table gives an empty result. Rounds grow with the logarithm of the longest chain. Edges never leave
    the executors: each round is written to the shared scratch folder, the driver sees a count and a checksum. A hub
    of any size is handled by a partial minimum and a join that can be split on the hub's side.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    given = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    lone = given.where("a = b").select(F.col("a").alias("id")).distinct()
    links = given.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = scratch.cut_state(links, "a", "b")
    for _ in range(max_rounds):
        if not seen[0]:
            break
        new, now = scratch.cut_state(_small_star(_large_star(edges)), "a", "b")
        scratch.drop(edges)
        edges = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    centres = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("group_id"))
    linked = stars.unionByName(centres)
    return linked.unionByName(lone.join(linked.select("id"), "id", "left_anti").select("id", F.col("id").alias("group_id")))


def merge_links(candidates: DataFrame, key: str = "id", into: str = "merged_into") -> DataFrame:
    """a, b: a row's key and the other existing key that its ``into`` names, trimmed and in lower case."""
    said = candidates.select(F.col(key).alias("a"), F.lower(F.trim(F.col(into), F.lit(" \t\r\n"))).alias("b")).where("a is not null and b <> a").distinct()
    keys = candidates.select(F.col(key).alias("b")).where("b is not null").distinct()
    return said.join(keys, "b", "left_semi").select("a", "b")


def merge_groups(candidates: DataFrame, key: str = "id", into: str = "merged_into") -> DataFrame:
    """id, group_id of every candidate, whether linked or not; a null key is no candidate."""
    linked = connected_components(merge_links(candidates, key, into))
    keys = candidates.select(F.col(key).alias("id")).where("id is not null").distinct()
    return keys.join(linked, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
