"""Relationship extraction: triggers between entities named in one sentence, nearest before and nearest after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import occurrences, sentences, strip
from graphloom.ontology import Ontology
from graphloom.operators.entities import ORDER, confidence

_CHUNK = ("document", "chunk_id")


def chunk_sentences(chunks: DataFrame) -> DataFrame:
    """chunk_id, document, sentence_no, sentence."""
    return chunks.select(*_CHUNK, F.posexplode(sentences(F.col("content"))).alias("sentence_no", "sentence"))


def trigger_spans(sents: DataFrame, ontology: Ontology) -> DataFrame:
    """One row for each occurrence of a trigger in a sentence: kind, start, end. Occurrences of one trigger don't overlap.

    The triggers are literals, so sentences without one are dropped before anything is joined.
    """
    known = _triggers(ontology)
    low = sents.select(*_CHUNK, "sentence_no", F.lower("sentence").alias("low"))
    hit = low.select("*", F.explode(F.filter(known, lambda t: F.instr(F.col("low"), t["words"]) > 0)).alias("t"))
    spans = hit.select(*_CHUNK, "sentence_no", "low", "t.kind", "t.words", F.explode(occurrences(F.col("low"), F.col("t.words"))).alias("start"))
    return spans.select(*_CHUNK, "sentence_no", "low", "kind", "start", (F.col("start") + F.char_length("words")).alias("end"))


def _triggers(ontology: Ontology) -> Column:
    return F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("words")) for kind, t in ontology.triggers])


def _located(sents: DataFrame, found: DataFrame, ents: DataFrame) -> DataFrame:
    """Sentences (with ``low``, their lower case) beside ``places``: an array of (entity_id, seq, at) of the chunk's entities
    that they name; those with fewer than two are dropped. A sentence meets its chunk's names in one row."""
    named = found.join(ents.select(F.col("id").alias("entity_id"), F.lower("name").alias("n")), "entity_id")
    names = named.groupBy("chunk_id").agg(F.collect_list(F.struct("entity_id", F.col("pos").alias("seq"), "n")).alias("names")).where("size(names) > 1")
    at = F.transform("names", lambda x: F.struct(x["entity_id"].alias("entity_id"), x["seq"].alias("seq"), (F.instr(F.col("low"), x["n"]) - 1).alias("at")))
    # made by a generator of one row, so that the filter above it doesn't make it again
    once = F.explode(F.array(F.filter(at, lambda x: x["at"] >= 0))).alias("places")
    return sents.join(names, "chunk_id").select(*sents.columns, once).where("size(places) > 1")


def positions(sents: DataFrame, found: DataFrame, ents: DataFrame) -> DataFrame:
    """Document, chunk_id, sentence_no, entity_id, seq, at: first place of each entity of the chunk in its sentences.

    found: chunk_id, document, entity_id, pos (mentions); ents: id, name (one row an id). Sentences with fewer than two
    entities are dropped.
    """
    low = sents.select(*_CHUNK, "sentence_no", F.lower("sentence").alias("low"))
    return _located(low, found, ents).select(*_CHUNK, "sentence_no", F.inline("places"))


def first_triples(rows: DataFrame) -> DataFrame:
    """Source, relationship, target, source_chunk: each triple once, with its first chunk in document order."""
    return rows.groupBy("source", "relationship", "target").agg(F.min(F.struct(*ORDER)).alias("x")).select(
        "source", "relationship", "target", F.col("x.chunk_id").alias("source_chunk")
    )


def extract_relationships(chunks: DataFrame, ents: DataFrame, found: DataFrame, ontology: Ontology | None = None) -> DataFrame:
    """Relationships of chunks (chunk_id, document, content) between their mentioned entities.

    R4: source and target of a trigger are the entity that starts last before it and the one that starts first after
    it; of equal starts the one mentioned first counts; an entity isn't related to itself. Only sentences with a trigger
    meet the names, by chunk; all else happens within a sentence's row.
    """
    known = _triggers(ontology or Ontology())
    low = chunk_sentences(chunks).select(*_CHUNK, "sentence_no", F.explode(F.array(F.lower("sentence"))).alias("low"))
    hit = low.where(F.exists(known, lambda t: F.instr(F.col("low"), t["words"]) > 0))
    placed = _located(hit, found, ents)
    spans = F.flatten(
        F.transform(
            F.filter(known, lambda t: F.instr(F.col("low"), t["words"]) > 0),
            lambda t: F.transform(occurrences(F.col("low"), t["words"]), lambda s: F.struct(t["kind"].alias("kind"), s.alias("start"), (s + F.char_length(t["words"])).alias("end"))),
        )
    )
    each = placed.select(*_CHUNK, "places", F.explode(spans).alias("span"))
    before = F.array_max(F.transform(F.filter("places", lambda x: x["at"] < F.col("span.start")), lambda x: F.struct(x["at"].alias("at"), (-x["seq"]).alias("s"), x["entity_id"].alias("id"))))
    after = F.array_min(F.transform(F.filter("places", lambda x: x["at"] >= F.col("span.end")), lambda x: F.struct(x["at"].alias("at"), x["seq"].alias("s"), x["entity_id"].alias("id"))))
    pairs = each.select(*_CHUNK, F.col("span.kind").alias("relationship"), F.explode(F.array(F.struct(before["id"].alias("source"), after["id"].alias("target")))).alias("p"))
    return first_triples(pairs.where("p.source <> p.target").select(*_CHUNK, "p.source", "relationship", "p.target"))


def model_relationships(parsed: DataFrame, named: DataFrame, ontology: Ontology) -> DataFrame:
    """chunk_id, source, relationship, target, confidence_score from a model's answers, ends resolved by name in the chunk.

    named: chunk_id, entity_id, name, pos; of equal names in a chunk the last one counts.
    """
    rows = parsed.select("chunk_id", F.explode("relationships").alias("r"))
    rel = rows.select(
        "chunk_id", F.lower(strip(F.col("r.source"))).alias("s"), F.lower(strip(F.col("r.target"))).alias("t"), F.col("r.relationship").alias("relationship"),
        confidence(F.col("r.confidence_score")).alias("confidence_score"),
    ).where(F.col("relationship").isin(*ontology.relationship_types))
    ends = named.groupBy("chunk_id", F.lower("name").alias("n")).agg(F.max_by("entity_id", "pos").alias("e"))
    out = (
        rel.join(ends.select("chunk_id", F.col("n").alias("s"), F.col("e").alias("source")), ["chunk_id", "s"])
        .join(ends.select("chunk_id", F.col("n").alias("t"), F.col("e").alias("target")), ["chunk_id", "t"])
        .where("source <> target")
    )
    return out.select("chunk_id", "source", "relationship", "target", "confidence_score")


def merge_relationships(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Triples of both extractors (with source_chunk); a triple of both keeps the rules' chunk."""
    cols = ["source", "relationship", "target", "source_chunk"]
    both = rule.select(*cols, F.lit(0).alias("rank")).unionByName(model.select(*cols, F.lit(1).alias("rank")))
    return both.groupBy("source", "relationship", "target").agg(F.min(F.struct("rank", "source_chunk")).alias("x")).select("source", "relationship", "target", "x.source_chunk")
