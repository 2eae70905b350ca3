"""The pipeline: documents to chunks, entities, relationships and candidates, and the published graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.contracts import conform
from graphloom.ontology import Ontology
from graphloom.operators import candidates, chunking, diff, embed, entities, graph, relations
from graphloom.scratch import Scratch
from graphloom.sources.files import read_table
from graphloom.sources.sinks import overwrite, upsert, upsert_graph, write_snapshot


@dataclass
class Pipeline:
    """Stages that each read their input from storage and write their output, so any of them can be run again."""

    spark: SparkSession
    root: str
    now: str
    ontology: Ontology
    embedder: embed.Embedder | None = None
    embedding_model: str = "hashing-64"
    model: Callable[[list[dict]], str] | None = None

    def _read(self, table: str) -> DataFrame:
        return read_table(self.spark, self.root, table)

    def _write(self, df: DataFrame, table: str) -> None:
        overwrite(conform(df, table), self.root, table)

    def documents(self, docs: DataFrame) -> None:
        """Documents with their Markdown, from any source."""
        self._write(docs, "markdown")

    def chunks(self) -> None:
        self._write(chunking.chunk_documents(self._read("markdown")), "chunks")

    def embeddings(self) -> None:
        c = self._read("chunks")
        self._write(embed.embed_chunks(c, self.embedder, self.embedding_model) if self.embedder else embed.no_embedding(c), "embeddings")

    def extraction(self) -> None:
        """Entities, mentions and relationships; chunks without a mention go to the model, where there is one."""
        c = self._read("chunks")
        raw = Scratch(self.spark, "extraction").cut(entities.raw_entities(c, self.ontology))  # read by three consumers
        ents, found = entities.one_per_id(entities.entities(raw)), entities.mentions(raw)
        rels = relations.extract_relationships(c, ents, found, self.ontology)
        if self.model:
            routed = entities.route(c, found).where("to_model").select(*c.columns)
            overwrite(entities.call_model(routed, self.model), self.root, "model_responses")
            parsed = entities.parse_responses(self.spark.read.parquet(f"{self.root}/model_responses"))
            more = entities.model_entities(parsed, self.ontology).join(c.select("chunk_id", "document"), "chunk_id")
            new, seen = entities.one_per_id(entities.entities(more)), entities.mentions(more)
            named = seen.join(new.select(F.col("id").alias("entity_id"), "name"), "entity_id")
            extra = relations.model_relationships(parsed, named, self.ontology).join(c.select("chunk_id", "document"), "chunk_id")
            rels = relations.merge_relationships(rels, relations.first_triples(extra))
            ents, found = entities.merge(ents, new), found.unionByName(seen)
        self._write(ents.drop("first"), "entities")
        overwrite(found, self.root, "mentions")
        self._write(rels, "relationships")

    def candidates(self) -> dict[str, int]:
        """Candidate rows of what isn't decided yet, upserted; A14: the numbers of rows saved."""
        c, ents, found, rels = (self._read(t) for t in ("chunks", "entities", "mentions", "relationships"))
        old_e, old_r = self._read("candidate_entities"), self._read("candidate_relationships")
        new_e = candidates.build_entities(ents, found, c, self.now, self.ontology, old_e)
        new_r = candidates.build_relationships(rels, candidates.mention_counts(ents, found), c, self.now, old_r)
        return {t: upsert(rows, self.root, t) for t, rows in (("candidate_entities", new_e), ("candidate_relationships", new_r))}

    def _graph(self, e: DataFrame, m: DataFrame, r: DataFrame, silver: bool) -> graph.Graph:
        docs, c = self._read("markdown"), self._read("chunks")
        if silver:
            docs, c = docs.limit(0), c.limit(0)
        r = r if "source_chunk" in r.columns else r.withColumn("source_chunk", F.lit(None).cast("string"))
        return graph.build_graph(docs, c, e, m, r)

    def candidate_graph(self) -> None:
        """The graph of all that may be published, in a folder of its own, replaced each time."""
        g = graph.candidate_graph(self._read("candidate_entities"), self._read("candidate_relationships"))
        write_snapshot(self._graph(*g, silver=True), self.root, "candidate_graph")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """All stages up to the candidate graph; the documents' changes against the run before."""
        before = self._read("markdown").select("document_id", "content_hash")
        changes = Scratch(self.spark, "ingest").cut(diff.ingest_diff(before, conform(docs, "markdown")))  # before the table is replaced
        self.documents(docs)
        for stage in (self.chunks, self.embeddings, self.extraction, self.candidates, self.candidate_graph):
            stage()
        return changes

    def publish_ontology(self) -> None:
        """Approved entities and relationships as tables."""
        e, r = graph.ontology_tables(self._read("candidate_entities"), self._read("candidate_relationships"))
        overwrite(conform(graph.require_approved(e), "approved_entities"), self.root, "approved_entities")
        overwrite(conform(r, "approved_relationships"), self.root, "approved_relationships")

    def publish_graph(self) -> DataFrame:
        """The approved graph upserted into the published one; rows submitted and effective."""
        e, m, r = graph.approved_graph(self._read("candidate_entities"), self._read("candidate_relationships"), self._read("mentions"))
        graph.require_approved(e)
        g = self._graph(e, m, r, silver=False)
        upsert_graph(graph.loadable(g), self.root, "graph")
        return graph.load_stats(g)
