"""Candidate building: mentions and occurrences aggregated into rows with confidence, evidence and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import WS, relationship_id, snippet
from graphloom.ontology import Ontology, literal_map

MAX_SNIPPETS = 3
# What is said of a candidate.
DEFAULT_DEFINITION = "{name} is a concept identified in the reviewed documents."
DEFAULT_MEANING = "Its business significance has not yet been described."
MENTIONED, AMBIGUOUS, OCCURRED = "Auto-created from %d mention(s).", " Flagged for ambiguity.", "Auto-created from %d occurrence(s)."
HISTORY = "array<struct<timestamp:string,reviewer:string,action:string,comment:string>>"


def mention_counts(ents: DataFrame, mentions: DataFrame) -> DataFrame:
    """A1, A2: entity id, n_mentions, confidence_score = min(1, n / 10) to two places."""
    n = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    out = ents.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_mentions"))
    return out.withColumn("confidence_score", F.round(F.least(F.lit(1.0), F.col("n_mentions") / 10.0), 2))


def evidence(links: DataFrame, chunks: DataFrame, key: str, limit: int = MAX_SNIPPETS) -> DataFrame:
    """Key, evidence: the first different snippets of an entity's (or relationship's) chunks in order.

    links: key, chunk_id, seq. Snippets are ranked before they are gathered, so an array holds ``limit`` at most,
    and only the starts of contents are shuffled.
    """
    starts = chunks.select("chunk_id", snippet(F.col("content")).alias("snippet")).where("snippet <> ''")
    first = links.join(starts, "chunk_id").groupBy(key, "snippet").agg(F.min(F.struct("seq", "chunk_id")).alias("at"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("r") <= limit)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "snippet"))), lambda x: x["snippet"]).alias("evidence"))


def sources(links: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """A4, A5: key, source_documents (different ones, in order of first mention), source_chunks (all, in order)."""
    docs = links.join(chunks.select("chunk_id", "document"), "chunk_id").groupBy(key, "document").agg(F.min(F.struct("seq", "chunk_id")).alias("at"))
    by_doc = docs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "document"))), lambda x: x["document"]).alias("source_documents"))
    by_chunk = links.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunks"))
    return by_chunk.join(by_doc, key, "left").withColumn("source_documents", F.coalesce("source_documents", F.array().cast("array<string>")))


def possible_meanings(name: Column, ontology: Ontology) -> Column:
    """Meanings of the first ambiguous word of a name; empty where there is none."""
    terms = literal_map(ontology.ambiguous_terms)
    hits = F.filter(F.split(F.lower(name), f"{WS}+"), lambda w: F.map_contains_key(terms, w))
    return F.when(F.size(hits) > 0, F.try_element_at(terms, F.get(hits, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def template(name: Column, type_: Column, templates: dict[str, str], default: str) -> Column:
    """The template of the type, or the default, with ``{name}`` filled in."""
    text = F.coalesce(F.try_element_at(literal_map(templates), type_), F.lit(default)) if templates else F.lit(default)
    return F.replace(text, F.lit("{name}"), name)


def history_entry(now: str, reviewer: str, action: str, comment: Column) -> Column:
    """One history entry."""
    return F.struct(F.lit(now).alias("timestamp"), F.lit(reviewer).alias("reviewer"), F.lit(action).alias("action"), comment.alias("comment"))


def undecided(rows: DataFrame, existing: DataFrame | None, decided: tuple[str, ...], key: str = "id") -> DataFrame:
    """Rows whose id has no decided row already."""
    if existing is None:
        return rows
    return rows.join(existing.where(F.col("status").isin(*decided)).select(key).distinct(), key, "left_anti")


def build_entities(
    ents: DataFrame, mentions: DataFrame, chunks: DataFrame, now: str, ontology: Ontology | None = None, existing: DataFrame | None = None,
    decided: tuple[str, ...] = ("APPROVED", "REJECTED", "MERGED"), definitions: dict[str, str] | None = None, meanings: dict[str, str] | None = None,
) -> DataFrame:
    """Candidate rows of entities (id, name, type; one row an id) that aren't decided yet.

    mentions: chunk_id, document, entity_id, pos. Entities without mentions get confidence 0 and empty arrays.
    """
    links = mentions.select(F.col("entity_id").alias("id"), "chunk_id", F.struct("document", "chunk_id").alias("seq"))
    rows = undecided(ents.select("id", "name", "type"), existing, decided)
    none = F.array().cast("array<string>")
    out = rows.join(mention_counts(ents, mentions), "id").join(evidence(links, chunks, "id"), "id", "left").join(sources(links, chunks, "id"), "id", "left")
    ambiguous = possible_meanings(F.col("name"), ontology or Ontology())
    comment = F.concat(F.format_string(MENTIONED, "n_mentions"), F.when(F.size("possible_meanings") > 0, F.lit(AMBIGUOUS)).otherwise(""))
    return out.withColumn("possible_meanings", ambiguous).select(
        "id", "name", F.col("type").alias("entity_type"),
        template(F.col("name"), F.col("type"), definitions or {}, DEFAULT_DEFINITION).alias("definition"),
        template(F.col("name"), F.col("type"), meanings or {}, DEFAULT_MEANING).alias("business_meaning"),
        "confidence_score", F.lit("PENDING_REVIEW").alias("status"),
        *[F.coalesce(c, none).alias(c) for c in ("evidence", "source_documents", "source_chunks")], "possible_meanings",
        F.array(history_entry(now, "pipeline", "created", comment)).cast(HISTORY).alias("history"),
        *[F.lit(None).cast("string").alias(c) for c in ("reviewer", "review_timestamp", "merged_into")],
    )


def group_relationships(rows: DataFrame) -> DataFrame:
    """Id, source, relationship, target, n_occurrences of each triple."""
    out = rows.groupBy("source", "relationship", "target").agg(F.count("*").alias("n_occurrences"))
    return out.withColumn("id", relationship_id(F.col("source"), F.col("relationship"), F.col("target")))


def relationship_confidence(triples: DataFrame, scores: DataFrame) -> DataFrame:
    """A10: adds confidence_score: mean of both ends' scores (0.5 where unknown) to two places. scores: id, confidence_score."""
    s = scores.select(F.col("id").alias("source"), F.col("confidence_score").alias("s"))
    t = scores.select(F.col("id").alias("target"), F.col("confidence_score").alias("t"))
    mean = (F.coalesce("s", F.lit(0.5)) + F.coalesce("t", F.lit(0.5))) / 2
    return triples.join(s, "source", "left").join(t, "target", "left").withColumn("confidence_score", F.round(mean, 2)).drop("s", "t")


def build_relationships(
    rels: DataFrame, scores: DataFrame, chunks: DataFrame, now: str, existing: DataFrame | None = None, decided: tuple[str, ...] = ("APPROVED", "REJECTED")
) -> DataFrame:
    """Candidate rows of relationships (source, relationship, target, source_chunk) that aren't decided yet."""
    triples = undecided(relationship_confidence(group_relationships(rels), scores), existing, decided)
    links = rels.select(relationship_id(F.col("source"), F.col("relationship"), F.col("target")).alias("id"), F.col("source_chunk").alias("chunk_id"), F.col("source_chunk").alias("seq"))
    out = triples.join(evidence(links, chunks, "id"), "id", "left")
    comment = F.format_string(OCCURRED, "n_occurrences")
    return out.select(
        "id", F.col("source").alias("source_entity"), F.col("relationship").alias("relationship_type"), F.col("target").alias("target_entity"),
        "confidence_score", F.lit("PENDING_REVIEW").alias("status"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        F.array(history_entry(now, "pipeline", "created", comment)).cast(HISTORY).alias("history"),
        *[F.lit(None).cast("string").alias(c) for c in ("reviewer", "review_timestamp")],
    )
