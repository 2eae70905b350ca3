"""Differences: a published graph against a proposed one, and one ingest run against the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.operators.graph import merge_map, resolved_edges

PROPOSED = ("APPROVED", "PENDING_REVIEW", "NEW")
_TRIPLE = ["source", "relationship", "target"]


def entity_diff(baseline: DataFrame, ents: DataFrame, proposed: tuple[str, ...] = PROPOSED) -> DataFrame:
    """Id, change ('added', 'removed', 'merged', 'modified'), before and after names and types, survivor.

    baseline: id, name, type. One full join on the id; a merged row in the baseline counts as merged only if its
    survivor is approved, else as removed.
    """
    now = ents.where(F.col("status").isin(*proposed)).select("id", F.col("name").alias("name_after"), F.col("entity_type").alias("type_after"), F.lit(True).alias("is_now"))
    was = baseline.select("id", F.col("name").alias("name_before"), F.col("type").alias("type_before"), F.lit(True).alias("was"))
    both = was.join(now, "id", "full_outer").join(merge_map(ents), "id", "left")
    differs = ~(F.col("name_before").eqNullSafe(F.col("name_after")) & F.col("type_before").eqNullSafe(F.col("type_after")))
    change = (
        F.when(F.col("was") & F.col("survivor").isNotNull(), "merged").when(F.col("was").isNull(), "added")
        .when(F.col("is_now").isNull(), "removed").when(differs, "modified")
    )
    out = both.where(F.col("was").isNotNull() | F.col("is_now").isNotNull()).withColumn("change", change).where("change is not null")
    return out.select("id", "change", "name_before", "type_before", "name_after", "type_after", F.when(F.col("change") == "merged", F.col("survivor")).alias("survivor"))


def relationship_diff(baseline: DataFrame, ents: DataFrame, rels: DataFrame, proposed: tuple[str, ...] = PROPOSED) -> DataFrame:
    """Source, relationship, target, change ('added' or 'removed') between different triples."""
    live = ents.where(F.col("status").isin(*proposed))
    edges = resolved_edges(rels.where(F.col("status").isin(*proposed)), merge_map(ents), live)
    now = edges.select(F.col("source_entity").alias("source"), F.col("relationship_type").alias("relationship"), F.col("target_entity").alias("target")).distinct()
    return set_diff(baseline.select(*_TRIPLE).distinct(), now, _TRIPLE)


def set_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys of only one side with change 'added' or 'removed'. Both sides have each key once, without nulls."""
    both = before.select(*key, F.lit(True).alias("_b")).join(after.select(*key, F.lit(True).alias("_a")), key, "full_outer")
    return both.where("_a is null or _b is null").select(*key, F.when(F.col("_b").isNull(), "added").otherwise("removed").alias("change"))


def deltas(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """node_delta (added - removed - merged), relationship_delta (added - removed)."""
    sign = F.when(F.col("change") == "added", 1).when(F.col("change").isin("removed", "merged"), -1).otherwise(0)
    a = entities.agg(F.coalesce(F.sum(sign), F.lit(0)).alias("node_delta"))
    b = relationships.agg(F.coalesce(F.sum(sign), F.lit(0)).alias("relationship_delta"))
    return a.join(b, F.lit(True))


def ingest_diff(before: DataFrame, after: DataFrame, key: str = "document_id", content: str = "content_hash") -> DataFrame:
    """Key, change ('added', 'removed', 'changed') between two runs' documents; equal contents have no row."""
    b = before.select(key, F.col(content).alias("_x"), F.lit(True).alias("_b"))
    a = after.select(key, F.col(content).alias("_y"), F.lit(True).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def orphan_documents(docs: DataFrame, hierarchy: DataFrame, links: DataFrame) -> DataFrame:
    """Documents that no hierarchy or link edge touches."""
    ends = [hierarchy.select("child_id"), hierarchy.select("parent_id"), links.select("source_id"), links.select("target_id")]
    touched = ends[0].toDF("document_id")
    for e in ends[1:]:
        touched = touched.unionByName(e.toDF("document_id"))
    return docs.join(touched.distinct(), "document_id", "left_anti")


def names_without(docs: DataFrame, pattern: str = r"Q\d+$") -> DataFrame:
    """Documents whose trimmed name doesn't match the pattern."""
    return docs.where(~strip(F.col("document_name")).rlike(pattern))
