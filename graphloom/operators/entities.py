"""Entity extraction by rules, and by an injected model where rules find too little."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import WS, entity_id, strip
from graphloom.ontology import Ontology

# Words that may join capitalised words, and words that never start a name.
GLUE = ("for", "of", "the", "to")
STOP_START = ("The", "This", "That", "These", "Those", "All", "It", "In", "On", "For", "And", "Or", "A", "An")
_WORD = r"[A-Z][A-Za-z0-9.\-]*"
_INNER = r"[A-Z](?:[A-Za-z0-9.\-]*[A-Za-z0-9\-])?"
_GLUE = f"(?:{'|'.join(GLUE)})"
#: A capitalised word and up to four more, or glue words, none after a full stop; without look-behind.
PHRASE = rf"\b(?:{_INNER}{WS}+(?:(?:{_INNER}|{_GLUE}){WS}+){{0,3}}(?:{_WORD}|{_GLUE})\b|{_WORD}\b)"
_LEAD = f"^(?:(?:{'|'.join(STOP_START)})(?: |$))+"
_TRAIL = f"(?:(?:^| )(?:{'|'.join(GLUE)}))+$"
#: Order of chunks: the order in which the first occurrence is found.
ORDER = ("document", "chunk_id")


def phrases(chunks: DataFrame) -> DataFrame:
    """chunk_id, document, pos, phrase: candidate names of each chunk in order, cleaned; null contents have none."""
    found = F.regexp_extract_all("content", F.lit(f"(?U){PHRASE}"), F.lit(0))

    def clean(raw: Column) -> Column:
        joined = F.trim(F.regexp_replace(raw, f"{WS}+", " "))
        return F.trim(F.regexp_replace(F.trim(F.regexp_replace(joined, _LEAD, "")), _TRAIL, ""))

    # cleaned inside the array: as a column above the generator it would be computed again in every filter pushed down
    return chunks.select("chunk_id", "document", F.posexplode(F.transform(found, clean)).alias("pos", "phrase")).where("phrase <> ''")


def classify(named: DataFrame, ontology: Ontology, phrase: str = "phrase") -> DataFrame:
    """Adds ``type`` (or null) of each phrase. A keyword as last word decides alone; then acronyms, then technologies.

    Each part is a column of its own, so that it is computed once a row.
    """
    rows = named.withColumn("_raw", F.substring_index(phrase, " ", -1)).withColumn("_bare", F.rtrim("_raw", F.lit(".,;:"))).withColumn("_last", F.lower("_bare"))
    rows = rows.withColumn("_kind", ontology.type_of(F.col("_last")))
    raw, kind = F.col("_raw"), F.col("_kind")
    several = F.instr(phrase, " ") > 0
    acronym = F.length(raw).between(2, 6) & (F.upper(raw) == raw) & (F.lower(raw) != raw)
    known = ontology.is_technology(F.lower(phrase)) | ontology.is_technology(F.col("_last"))
    by_keyword = F.when((kind != "Document") & (several | acronym | known), kind)
    type_ = F.when(kind.isNotNull(), by_keyword).otherwise(F.coalesce(ontology.domain_type(F.col("_bare")), F.when(known, F.lit("Technology"))))
    return rows.withColumn("type", type_).drop("_raw", "_bare", "_last", "_kind")


def topics(chunks: DataFrame) -> DataFrame:
    """The innermost heading of each chunk as a Topic, before its phrases; not where it is the document's own id."""
    heading = strip(F.element_at(F.split(F.coalesce("section_path", F.lit("")), " > "), -1))
    return chunks.select("chunk_id", "document", F.lit(-1).alias("pos"), heading.alias("name"), F.lit("Topic").alias("type")).where(
        "name <> '' and not (name <=> document)"
    )


def raw_entities(chunks: DataFrame, ontology: Ontology) -> DataFrame:
    """chunk_id, document, pos, name, type: each (name without case, type) of a chunk once, first spelling."""
    typed = classify(phrases(chunks), ontology).select("chunk_id", "document", "pos", F.col("phrase").alias("name"), "type")
    every = topics(chunks).unionByName(typed.where("type is not null"))
    first = every.groupBy("chunk_id", "document", F.lower("name").alias("k"), "type").agg(F.min(F.struct("pos", "name")).alias("x"))
    return first.select("chunk_id", "document", "x.pos", "x.name", "type")


def entities(raw: DataFrame) -> DataFrame:
    """Id, name, type, source_chunk, first: one row for each (name without case, type), from its first chunk in document order."""
    first = raw.groupBy(F.lower("name").alias("k"), "type").agg(F.min(F.struct(*ORDER, "pos", "name")).alias("x"))
    at = F.struct(*[F.col(f"x.{c}").alias(c) for c in (*ORDER, "pos")]).alias("first")
    return first.select(entity_id(F.col("type"), F.col("x.name")).alias("id"), "x.name", "type", F.col("x.chunk_id").alias("source_chunk"), at)


def one_per_id(found: DataFrame) -> DataFrame:
    """Identity rule: names that differ in signs only share an id; the row that is found last keeps it."""
    last = found.groupBy("id").agg(F.max(F.struct("first", "name", "type", "source_chunk")).alias("x"))
    return last.select("id", "x.name", "x.type", "x.source_chunk", "x.first")


def mentions(raw: DataFrame) -> DataFrame:
    """chunk_id, entity_id, pos: each entity of a chunk once, with its first position."""
    return raw.groupBy("chunk_id", "document", entity_id(F.col("type"), F.col("name")).alias("entity_id")).agg(F.min("pos").alias("pos"))


def extract(chunks: DataFrame, ontology: Ontology | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and mentions of chunks (chunk_id, document, section_path, content) by rules."""
    raw = raw_entities(chunks, ontology or Ontology())
    return entities(raw), mentions(raw)


def route(chunks: DataFrame, found: DataFrame, minimum: int = 1) -> DataFrame:
    """Chunks with n_mentions and ``to_model``: those with fewer mentions than ``minimum``, none included."""
    n = found.groupBy("chunk_id").agg(F.count("*").alias("n_mentions"))
    return chunks.join(n, "chunk_id", "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0))).withColumn("to_model", F.col("n_mentions") < minimum)


def merge(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Entities of both extractors, one row an id; the rules' row wins."""
    cols = ["id", "name", "type", "source_chunk"]
    both = rule.select(*cols, F.lit(0).alias("rank")).unionByName(model.select(*cols, F.lit(1).alias("rank")))
    return both.groupBy("id").agg(F.min(F.struct("rank", "name", "type", "source_chunk")).alias("x")).select("id", "x.name", "x.type", "x.source_chunk")


#: X11: what a model answers for a batch of chunks.
RESPONSE = "chunks array<struct<chunk_id:string,entities:array<struct<name:string,type:string,confidence_score:string>>,relationships:array<struct<source:string,relationship:string,target:string,confidence_score:string>>>>"


def call_model(chunks: DataFrame, model: Callable[[list[dict]], str], batch: int = 8) -> DataFrame:
    """X11: chunk_ids, response (JSON text): the injected model is called for groups of chunks; keep the result as the cache.

    A call that fails gives an empty response, so its chunks yield nothing.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = part.to_dict("records")
            out = []
            for i in range(0, len(rows), batch):
                group = rows[i : i + batch]
                try:
                    answer = model(group)
                except Exception:  # noqa: BLE001
                    answer = ""
                out.append(([r["chunk_id"] for r in group], answer))
            yield pd.DataFrame(out, columns=["chunk_ids", "response"])

    return chunks.select("chunk_id", "document", "section_path", "content").mapInPandas(run, "chunk_ids array<string>, response string")


def parse_responses(responses: DataFrame) -> DataFrame:
    """X11: chunk_id, entities, relationships of well-formed answers about the chunks that were asked for."""
    parsed = responses.select("chunk_ids", F.from_json("response", RESPONSE).alias("r"))
    rows = parsed.select("chunk_ids", F.explode("r.chunks").alias("c"))
    return rows.where(F.array_contains("chunk_ids", F.col("c.chunk_id"))).select("c.chunk_id", "c.entities", "c.relationships")


def confidence(c: Column) -> Column:
    """A score within 0 and 1, 0.5 where none is given."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(0.5))))


def model_entities(parsed: DataFrame, ontology: Ontology) -> DataFrame:
    """chunk_id, pos, name, type, confidence_score: named entities of known types, each once a chunk."""
    rows = parsed.select("chunk_id", F.posexplode("entities").alias("pos", "e"))
    named = rows.select("chunk_id", "pos", strip(F.col("e.name")).alias("name"), F.col("e.type").alias("type"), confidence(F.col("e.confidence_score")).alias("confidence_score"))
    named = named.where((F.col("name") != "") & F.col("type").isin(*ontology.entity_types))
    w = Window.partitionBy("chunk_id", F.lower("name"), "type").orderBy("pos")
    return named.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
