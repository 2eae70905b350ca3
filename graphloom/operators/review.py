"""Updates of candidate rows by a table of actions, and the summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import merge_map

STATUSES = ("NEW", "PENDING_REVIEW", "APPROVED", "REJECTED", "MERGED")
DECIDED = ("APPROVED", "REJECTED", "MERGED")


def apply_actions(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """V1-V4: ``rows`` (with id and history) updated by actions: id, action, reviewer, timestamp, comment, updates.

    updates: map<string,string> of new values for string columns; a key with a null value clears the column, absent
    ones stay. Every action appends an entry to the history, in order of time (equal times: by reviewer, action
    and comment); of several updates of one column the last counts. Actions on unknown ids do nothing; rows without actions stay as they are.
    """
    none = F.create_map().cast("map<string,string>")
    entry = F.struct(*[F.col(c).cast("string").alias(c) for c in ("timestamp", "reviewer", "action", "comment")])
    ordered = F.array_sort(F.collect_list(F.struct(F.col("timestamp").alias("t"), entry.alias("e"), F.map_entries(F.coalesce("updates", none)).alias("u"))))
    per = actions.groupBy(F.col("id").alias("_id")).agg(ordered.alias("_a"))
    merged = F.aggregate(F.col("_a"), none, lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(F.map_from_entries(x["u"]), k)), F.map_from_entries(x["u"])))
    per = per.select("_id", F.transform("_a", lambda x: x["e"]).alias("_entries"), merged.alias("_u"))
    out = rows.join(per, rows["id"] == per["_id"], "left")
    strings = [f.name for f in rows.schema if f.dataType.simpleString() == "string" and f.name != "id"]

    def new(c: str) -> Column:
        has = F.map_contains_key("_u", F.lit(c))
        return F.when(F.coalesce(has, F.lit(False)), F.try_element_at("_u", F.lit(c))).otherwise(F.col(c)).alias(c)

    empty = F.array().cast(rows.schema["history"].dataType)
    history = F.concat(F.coalesce("history", empty), F.coalesce(F.col("_entries").cast(rows.schema["history"].dataType), empty)).alias("history")
    return out.select(*[history if c == "history" else new(c) if c in strings else rows[c] for c in rows.columns])


def filter_rows(rows: DataFrame, statuses: list[str] | None = None, categories: list[str] | None = None, category: str = "entity_type") -> DataFrame:
    """Rows of the chosen statuses and categories; None chooses all, an empty list none."""
    for c, chosen in (("status", statuses), (category, categories)):
        if chosen is not None:
            rows = rows.where(F.col(c).isin(*chosen) if chosen else F.lit(False))
    return rows


def category_pivot(rows: DataFrame, category: str = "entity_type") -> DataFrame:
    """V7: categories by number of rows in each status; the columns are fixed, so one aggregation does it."""
    return rows.groupBy(category).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def recent_activity(tables: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """V8: kind, id, timestamp, reviewer, action, comment of the latest history entries of all tables."""
    out = None
    for kind, df in tables.items():
        one = df.select(F.lit(kind).alias("kind"), "id", F.explode("history").alias("h")).select("kind", "id", "h.timestamp", "h.reviewer", "h.action", "h.comment")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("timestamp"), "kind", "id", "action", "reviewer", "comment").limit(limit)


def overview(ents: DataFrame) -> DataFrame:
    """n_documents, n_rows, n_decided, n_pending, n_ambiguous of candidate entities."""
    docs = ents.select(F.explode("source_documents").alias("d")).agg(F.countDistinct("d").alias("n_documents"))
    counts = ents.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("status").isin(*DECIDED)).alias("n_decided"), F.count_if(~F.col("status").isin(*DECIDED)).alias("n_pending"),
        F.count_if((F.size("possible_meanings") > 0) & ~F.col("status").isin(*DECIDED)).alias("n_ambiguous"),
    )
    return docs.join(counts, F.lit(True))


def pending_ambiguous(ents: DataFrame) -> DataFrame:
    """Rows with several meanings that aren't decided."""
    return ents.where((F.size("possible_meanings") > 0) & ~F.col("status").isin(*DECIDED))


def ready(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """V5: relationships with is_ready: both ends approved, or merged into approved ones."""
    ok = ents.where("status = 'APPROVED'").select("id").unionByName(merge_map(ents).select("id")).distinct()
    out = rels
    for end in ("source_entity", "target_entity"):
        out = out.join(ok.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    return out.withColumn("is_ready", F.coalesce(F.col("_source_entity") & F.col("_target_entity"), F.lit(False))).drop("_source_entity", "_target_entity")


def display_names(ents: DataFrame) -> DataFrame:
    """V6: id, display_name; of a merged row with the name of what it was merged into, or that id."""
    other = ents.select(F.col("id").alias("merged_into"), F.col("name").alias("_into")).dropDuplicates(["merged_into"])
    out = ents.join(other, "merged_into", "left")
    merged = F.concat(F.col("name"), F.lit(" (merged into "), F.coalesce("_into", "merged_into"), F.lit(")"))
    return out.select("id", F.when((F.col("status") == "MERGED") & F.col("merged_into").isNotNull(), merged).otherwise(F.col("name")).alias("display_name"))


def named(edges: DataFrame, ents: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_name: the name of each id, or the id itself."""
    for c in columns:
        names = ents.select(F.col("id").alias(c), F.col("name").alias("_n")).dropDuplicates([c])
        edges = edges.join(names, c, "left").withColumn(f"{c}_name", F.coalesce("_n", c)).drop("_n")
    return edges


def sorted_entities(ents: DataFrame) -> DataFrame:
    """Rows by name without case."""
    return ents.orderBy(F.lower("name"), "id")
