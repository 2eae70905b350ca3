"""Graph assembly: node and edge tables, merge resolution, and the candidate and approved graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import label_of, strip
from graphloom.ontology import RELATIONSHIP_TYPES

# Fixed value (G5): a link in a text: marker, label, address with the page's id; the address ends before the next
# marker, white space or the end.
_LINK = r"(?d)smallblue(.*?)(https://\S+?/pages/(\d+)/\S*?)(?=smallblue|\s|$)"
LIVE_EXCLUDED = ("REJECTED", "MERGED")


@dataclass
class Graph:
    """Three tables of nodes and five of edges."""

    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    has_chunk: DataFrame
    mentions: DataFrame
    relationships: DataFrame
    hierarchy: DataFrame
    links: DataFrame


def hierarchy_edges(docs: DataFrame) -> DataFrame:
    """child_id, parent_id where a parent is named."""
    parent = F.col("parent_page_id")
    return docs.where(parent.isNotNull() & (strip(parent) != "")).select(F.col("document_id").alias("child_id"), parent.alias("parent_id"))


def link_candidates(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """source_id, target_id, answer_label, known of every link in the texts; ``known``: the page is in the corpus."""
    labels, ids = (F.regexp_extract_all(text, F.lit(_LINK), F.lit(k)) for k in (1, 3))
    rows = docs.select(F.col("document_id").alias("source_id"), F.explode(F.arrays_zip(labels.alias("label"), ids.alias("id"))).alias("x"))
    known = docs.select(F.col("document_id").cast("string").alias("target_id")).distinct().withColumn("in_corpus", F.lit(True))
    out = rows.select("source_id", F.col("x.id").alias("target_id"), strip(F.col("x.label")).alias("answer_label"))
    return out.join(known, "target_id", "left").select("source_id", "target_id", "answer_label", F.coalesce("in_corpus", F.lit(False)).alias("known"))


def build_graph(docs: DataFrame, chunks: DataFrame, ents: DataFrame, mentions: DataFrame, rels: DataFrame) -> Graph:
    """The property graph of a corpus. Absent columns of documents are null."""
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    full = docs.select("*", *[has(c) for c in ("parent_page_id", "markdown", "space_key", "content_hash", "version") if c not in docs.columns])
    return Graph(
        full.select(F.col("document_id").alias("id"), F.col("document_name").alias("name"), "source_path", "space_key", "version", "content_hash"),
        chunks.select(F.col("chunk_id").alias("id"), "document", "section_path", "content"),
        ents.select("id", "name", "type", "source_chunk", label_of(F.col("type")).alias("label")),
        chunks.select(F.col("document").alias("document_id"), "chunk_id"),
        mentions.select("chunk_id", "entity_id"),
        rels.select("source", "relationship", "target", "source_chunk"),
        hierarchy_edges(full),
        link_candidates(full).where("known").select("source_id", "target_id", "answer_label"),
    )


def stats(graph: Graph) -> DataFrame:
    """Kind, n_rows of each table of the graph."""
    out = None
    for kind, df in vars(graph).items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(kind).alias("kind"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def with_endpoints(edges: DataFrame, a: str, left: DataFrame, b: str, right: DataFrame) -> DataFrame:
    """Edges of which both ends exist (left and right: id)."""
    return edges.join(left.select(F.col("id").alias(a)).distinct(), a, "left_semi").join(right.select(F.col("id").alias(b)).distinct(), b, "left_semi")


def loadable(graph: Graph, allowed: tuple[str, ...] = tuple(RELATIONSHIP_TYPES)) -> Graph:
    """The graph as it stands once loaded: one node an id, edges with both ends, of allowed types, once a key."""
    d, c, e = (df.dropDuplicates(["id"]) for df in (graph.documents, graph.chunks, graph.entities))
    rel = graph.relationships.where(F.col("relationship").isin(*allowed))
    return Graph(
        d, c, e,
        with_endpoints(graph.has_chunk, "document_id", d, "chunk_id", c).dropDuplicates(),
        with_endpoints(graph.mentions, "chunk_id", c, "entity_id", e).dropDuplicates(),
        with_endpoints(rel, "source", e, "target", e).groupBy("source", "relationship", "target").agg(F.max("source_chunk").alias("source_chunk")),
        with_endpoints(graph.hierarchy, "child_id", d, "parent_id", d).dropDuplicates(),
        with_endpoints(graph.links, "source_id", d, "target_id", d).dropDuplicates(["source_id", "target_id", "answer_label"]),
    )


def load_stats(graph: Graph) -> DataFrame:
    """Kind, n_submitted, n_effective: rows given and rows in the loaded graph."""
    given = stats(graph).withColumnRenamed("n_rows", "n_submitted")
    return given.join(stats(loadable(graph)).withColumnRenamed("n_rows", "n_effective"), "kind")


def collapse_types(rels: DataFrame) -> DataFrame:
    """One edge for each (source, target); of several types the last by name stays."""
    return rels.groupBy("source", "target").agg(F.max(F.struct("relationship", "source_chunk")).alias("x")).select("source", "target", "x.relationship", "x.source_chunk")


def merge_map(candidates: DataFrame, merged: str = "MERGED", approved: str = "APPROVED") -> DataFrame:
    """Id, survivor of merged rows whose survivor is itself approved; others have no row."""
    kept = candidates.where(F.col("status") == approved).select(F.col("id").alias("survivor")).distinct()
    return candidates.where(F.col("status") == merged).select("id", F.col("merged_into").alias("survivor")).join(kept, "survivor").select("id", "survivor").distinct()


def resolve(edges: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """``column`` replaced by its survivor, one step only."""
    m = merges.select(F.col("id").alias(column), F.col("survivor").alias("_survivor"))
    return edges.join(m, column, "left").withColumn(column, F.coalesce("_survivor", column)).drop("_survivor")


def resolved_edges(rels: DataFrame, merges: DataFrame, live: DataFrame) -> DataFrame:
    """Candidate relationships with resolved ends, no self loops, both ends among ``live`` (id)."""
    out = resolve(resolve(rels, "source_entity", merges), "target_entity", merges).where("source_entity <> target_entity")
    ids = live.select("id").distinct()
    return out.join(ids.withColumnRenamed("id", "source_entity"), "source_entity", "left_semi").join(ids.withColumnRenamed("id", "target_entity"), "target_entity", "left_semi")


def candidate_graph(ents: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and relationships of everything neither rejected nor merged; duplicates after merging stay."""
    live = ents.where(~F.col("status").isin(*LIVE_EXCLUDED))
    nodes = live.select("id", "name", F.col("entity_type").alias("type"), F.coalesce(F.get("source_chunks", F.lit(0)), F.lit("")).alias("source_chunk"))
    edges = resolved_edges(rels.where("status <> 'REJECTED'"), merge_map(ents), live)
    return (
        nodes,
        live.select(F.explode("source_chunks").alias("chunk_id"), F.col("id").alias("entity_id")),
        edges.select(F.col("source_entity").alias("source"), F.col("relationship_type").alias("relationship"), F.col("target_entity").alias("target")),
    )


def approved_graph(ents: DataFrame, rels: DataFrame, mentions: DataFrame, remap_mentions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and relationships that are approved. Mentions of merged entities are left out, or
    go to the survivor with ``remap_mentions``. No approved entity at all is an error of the caller's to check."""
    kept = ents.where("status = 'APPROVED'")
    merges = merge_map(ents)
    nodes = kept.select("id", "name", F.col("entity_type").alias("type"), F.coalesce(F.get("source_chunks", F.lit(0)), F.lit("")).alias("source_chunk"))
    edges = resolved_edges(rels.where("status = 'APPROVED'"), merges, kept)
    if remap_mentions:
        mentions = resolve(mentions, "entity_id", merges).distinct()
    return (
        nodes,
        mentions.join(kept.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("chunk_id", "entity_id"),
        edges.select(F.col("source_entity").alias("source"), F.col("relationship_type").alias("relationship"), F.col("target_entity").alias("target"), F.lit("approved_ontology").alias("source_chunk")),
    )


def require_approved(nodes: DataFrame) -> DataFrame:
    """``nodes``, or ValueError where there are none to publish."""
    if nodes.isEmpty():
        raise ValueError("nothing is approved yet")
    return nodes


def ontology_tables(ents: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved entities, and approved relationships with the names of their ends."""
    kept = ents.where("status = 'APPROVED'")
    entities = kept.select("id", "name", F.col("entity_type").alias("category"), "definition", "business_meaning", "confidence_score", "source_documents")
    edges = resolved_edges(rels.where("status = 'APPROVED'"), merge_map(ents), kept)
    for end in ("source", "target"):
        edges = edges.join(kept.select(F.col("id").alias(f"{end}_entity"), F.col("name").alias(f"{end}_name")), f"{end}_entity")
    return entities, edges.select("id", "source_entity", "source_name", "relationship_type", "target_entity", "target_name", "confidence_score")


def ontology_stats(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Kind ('category' or 'relationship_type'), value, n_rows."""
    a = entities.groupBy(F.col("category").alias("value")).agg(F.count("*").alias("n_rows")).select(F.lit("category").alias("kind"), "value", "n_rows")
    b = relationships.groupBy(F.col("relationship_type").alias("value")).agg(F.count("*").alias("n_rows")).select(F.lit("relationship_type").alias("kind"), "value", "n_rows")
    return a.unionByName(b)
