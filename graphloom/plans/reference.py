"""Queries over the document, extraction, candidate, graph and retrieval operators on the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.contracts import key_violations
from graphloom.functions.text import WS, label_of, relationship_id, token_count
from graphloom.ontology import RELATIONSHIP_TYPES, Ontology
from graphloom.operators import candidates, chunking, diff, embed, entities, graph, relations, retrieval, review
from graphloom.plans.core import table
from graphloom.scratch import Scratch
from graphloom.sources.files import clean_page
from graphloom.sources.sinks import merged

ONTOLOGY = Ontology()
NOW = "2026-01-01T00:00:00+00:00"


# --- tables that the queries share -------------------------------------------------------------------------------


def _last(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def live_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each chunk its last row, unless that is a deletion."""
    order = [F.col(c).desc_nulls_last() for c in ("loaded_at", "content", "section_path")]
    last = _last(table(spark, sf, "chunks").select("chunk_id", "document", "section_path", "content", "loaded_at", "is_deleted"), "chunk_id", *order)
    return last.where("not coalesce(is_deleted, false) and content is not null").select("chunk_id", "document", "section_path", "content")


def live_entities(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col(c).desc_nulls_last() for c in ("loaded_at", "name", "type")]
    return _last(table(spark, sf, "entities"), "id", *order).where("not coalesce(is_deleted, false)").select("id", "name", "type", "source_chunk")


def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Of each candidate the row with the longest history, types and merge targets in plain form."""
    order = [F.coalesce(F.size("history"), F.lit(-1)).desc(), *[F.col(c).desc_nulls_last() for c in ("review_timestamp", "status", "name", "merged_into")]]
    last = _last(table(spark, sf, "candidate_entities"), "id", *order)
    blanks = F.lit(" \t\r\n")
    return last.withColumn("entity_type", F.lower(F.trim("entity_type", blanks))).withColumn("merged_into", F.lower(F.trim("merged_into", blanks)))


def edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    """source, relationship, target, source_chunk: every raw relationship with both ends, in plain form."""
    plain = lambda c: F.nullif(F.lower(F.trim(F.col(c), F.lit(" \t"))), F.lit("")).alias(c)
    rows = table(spark, sf, "relationships").select(plain("source"), F.upper(F.trim("relationship")).alias("relationship"), plain("target"), "source_chunk")
    return rows.where("source is not null and target is not null and relationship is not null")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return edge_rows(spark, sf).groupBy("source", "relationship", "target").agg(F.min("source_chunk").alias("source_chunk"))


def mention_rows(spark: SparkSession, sf: str) -> DataFrame:
    """chunk_id, entity_id: entities that a relationship of the chunk names."""
    e = edge_rows(spark, sf).where("source_chunk is not null")
    return e.select(F.col("source_chunk").alias("chunk_id"), F.explode(F.array("source", "target")).alias("entity_id")).distinct()


def candidate_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """The relationships as candidates; their table isn't given, so the status follows from the id."""
    states = F.array(*[F.lit(s) for s in ("PENDING_REVIEW", "APPROVED", "REJECTED", "NEW")])
    rid = relationship_id(F.col("source"), F.col("relationship"), F.col("target"))
    rows = edges(spark, sf).withColumn("id", rid).withColumn("status", F.get(states, F.length("id") % 4))
    return rows.select("id", F.col("source").alias("source_entity"), F.col("relationship").alias("relationship_type"), F.col("target").alias("target_entity"), F.lit(0.5).alias("confidence_score"), "status")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Of each page its last version."""
    order = [F.col("version").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ("parent_page_id", "space_key", "ingested_at")]]
    return _last(table(spark, sf, "raw_documents"), "document_id", *order)


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "markdown").groupBy("document_id").agg(F.max("markdown").alias("markdown"))


# SQL's word boundaries know ASCII letters only: other letters are read as ``_`` and other signs as ``~``, none of which a phrase holds
_SPACES = WS[1:-1].replace(r"\s", "").replace(r"\x0B", "").replace(r"\x{1C}-\x{1F}", "")
_BASE = f"""
    live_chunks AS (
        SELECT chunk_id, document, section_path, content FROM (
            SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, content DESC NULLS LAST, section_path DESC NULLS LAST) AS n
            FROM chunks WHERE chunk_id IS NOT NULL)
        WHERE n = 1 AND NOT coalesce(is_deleted, false) AND content IS NOT NULL),
    live_entities AS (
        SELECT id, name, type, source_chunk FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, name DESC NULLS LAST, type DESC NULLS LAST) AS n
            FROM entities WHERE id IS NOT NULL)
        WHERE n = 1 AND NOT coalesce(is_deleted, false)),
    cand AS (
        SELECT * EXCLUDE (n) REPLACE (lower(trim(entity_type, chr(32) || chr(9) || chr(13) || chr(10))) AS entity_type,
            lower(trim(merged_into, chr(32) || chr(9) || chr(13) || chr(10))) AS merged_into) FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(len(history), -1) DESC, review_timestamp DESC NULLS LAST,
                status DESC NULLS LAST, name DESC NULLS LAST, merged_into DESC NULLS LAST) AS n
            FROM candidate_entities WHERE id IS NOT NULL)
        WHERE n = 1),
    edge_rows AS (
        SELECT * FROM (SELECT nullif(lower(trim(source, chr(32) || chr(9))), '') AS source, upper(trim(relationship)) AS relationship,
            nullif(lower(trim(target, chr(32) || chr(9))), '') AS target, source_chunk FROM relationships)
        WHERE source IS NOT NULL AND target IS NOT NULL AND relationship IS NOT NULL),
    edges AS (SELECT source, relationship, target, min(source_chunk) AS source_chunk FROM edge_rows GROUP BY ALL),
    mentions AS (
        SELECT source_chunk AS chunk_id, source AS entity_id FROM edge_rows WHERE source_chunk IS NOT NULL
        UNION SELECT source_chunk, target FROM edge_rows WHERE source_chunk IS NOT NULL),
    cand_rels AS (
        SELECT id, source AS source_entity, relationship AS relationship_type, target AS target_entity, 0.5::DOUBLE AS confidence_score,
            ['PENDING_REVIEW', 'APPROVED', 'REJECTED', 'NEW'][len(id) % 4 + 1] AS status
        FROM (SELECT *, 'rel__' || source || '__' || relationship || '__' || target AS id FROM edges)),
    docs AS (
        SELECT * EXCLUDE (n) FROM (
            SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC NULLS LAST, parent_page_id DESC NULLS LAST,
                space_key DESC NULLS LAST, ingested_at DESC NULLS LAST) AS n
            FROM raw_documents WHERE document_id IS NOT NULL)
        WHERE n = 1),
    md AS (SELECT document_id, max(markdown) AS markdown FROM markdown GROUP BY document_id),
    spelt AS (SELECT chunk_id, document, regexp_replace(regexp_replace(content, '[^\\x00-\\x7F\\pL\\pN\\pM{_SPACES}]', '~', 'g'), '[^\\x00-\\x7F{_SPACES}]', '_', 'g') AS content FROM live_chunks),
    merges AS (
        SELECT DISTINCT m.id, m.merged_into AS survivor FROM cand m JOIN cand a ON a.id = m.merged_into AND a.status = 'APPROVED' WHERE m.status = 'MERGED')"""


def _sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_BASE}{', ' + more if more else ''}{body if body.startswith(',') else ' ' + body}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"greatest(1, CAST(floor(len(list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')) * 4 / 3) AS INTEGER))"


def _slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({_strip(x)}), '[^a-z0-9]+', '_', 'g'), '_'), ''), left(md5({x}), 8))"


def _snippet(x: str) -> str:
    return f"left(replace({_strip(x)}, chr(10), ' '), 200)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- text and chunking -------------------------------------------------------------------------------------------


@query(_sql(f"SELECT chunk_id, {_tokens('content')} AS tokens FROM live_chunks"))
def t1_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token count of every chunk."""
    return live_chunks(spark, sf).select("chunk_id", token_count(F.col("content")).alias("tokens"))


_LINES = f"""
    split AS (SELECT document_id, string_split(markdown, chr(10)) AS l FROM md WHERE markdown IS NOT NULL),
    raw_lines AS (SELECT document_id, i - 1 AS line_no, l[i] AS line FROM split, unnest(range(1, len(l) + 1)) AS u(i)),
    lines AS (SELECT *, CASE WHEN regexp_matches(line, '(?s)^(#{{1,6}}){WS}+(.*)$') THEN len(regexp_extract(line, '^(#+)', 1)) END AS level FROM raw_lines),
    titled AS (SELECT *, CASE WHEN level IS NOT NULL THEN {_strip(f"regexp_replace(line, '^#{{1,6}}{WS}+', '')")} END AS title FROM lines),
    numbered AS (SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY line_no) AS section_no FROM titled)"""
_BLOCKS = rf"""{_LINES},
    kinds AS (SELECT document_id, section_no, line_no, line, CASE WHEN {_strip("line")} = '' THEN 'B' WHEN starts_with({_strip("line")}, '|') THEN 'T'
        WHEN regexp_matches(line, '^({WS}*[-*+]{WS}+|{WS}*[0-9]+[.)]{WS}+)') THEN 'L' WHEN regexp_matches(line, '^[ \t]') THEN 'I' ELSE 'X' END AS kind
        FROM numbered WHERE level IS NULL),
    states AS (SELECT *, coalesce(last_value(CASE kind WHEN 'I' THEN NULL WHEN 'T' THEN 'T' WHEN 'L' THEN 'L' ELSE 'N' END IGNORE NULLS)
        OVER (PARTITION BY document_id, section_no ORDER BY line_no), 'N') AS state FROM kinds),
    prevs AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY document_id, section_no ORDER BY line_no), 'N') AS prev FROM states),
    cuts AS (SELECT *, sum(CASE WHEN (kind IN ('B', 'T') AND prev = 'N') OR (kind = 'X' AND prev <> 'N') THEN 1 ELSE 0 END)
        OVER (PARTITION BY document_id, section_no ORDER BY line_no) AS block_no FROM prevs),
    blocks AS (SELECT document_id, section_no, block_no, {_strip("string_agg(line, chr(10) ORDER BY line_no)")} AS block FROM cuts
        WHERE NOT (kind = 'B' AND prev = 'N') GROUP BY ALL)"""


@query(
    _sql(
        "SELECT document_id, CAST(section_no AS BIGINT) AS section_no, CAST(max(level) AS INTEGER) AS level, max(title) AS title, count(*) AS n_lines FROM numbered GROUP BY document_id, section_no",
        _LINES,
    )
)
def t2_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of every page: heading, level and number of lines."""
    rows = chunking.with_sections(chunking.lines(markdown(spark, sf)))
    return rows.groupBy("document_id", "section_no").agg(F.max("level").alias("level"), F.max("title").alias("title"), F.count("*").alias("n_lines"))


_LEVELS = ", ".join(
    f"last_value(CASE WHEN level = {k} THEN {{'n': line_no, 't': title}} END IGNORE NULLS) OVER w AS h{k}, "
    f"coalesce(last_value(CASE WHEN level < {k} THEN line_no END IGNORE NULLS) OVER w, -1) AS c{k}"
    for k in range(1, 7)
)


@query(
    _sql(
        "SELECT document_id, CAST(section_no AS BIGINT) AS section_no, section_path FROM (SELECT DISTINCT document_id, section_no, coalesce(nullif(array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN h{k}.n > c{k} THEN h{k}.t END" for k in range(1, 7))
        + f"], lambda t: t IS NOT NULL AND t <> ''), ' > '), ''), document_id) AS section_path FROM (SELECT *, {_LEVELS} FROM numbered WINDOW w AS (PARTITION BY document_id ORDER BY line_no)))",
        _LINES,
    )
)
def t3_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path of every section."""
    rows = chunking.with_sections(chunking.lines(markdown(spark, sf)))
    path = F.coalesce(F.nullif(F.array_join("section", " > "), F.lit("")), F.col("document_id"))
    return rows.select("document_id", "section_no", path.alias("section_path")).distinct()


@query(_sql("SELECT document_id, CAST(section_no AS BIGINT) AS section_no, CAST(block_no AS BIGINT) AS block_no, block FROM blocks WHERE block <> ''", _BLOCKS))
def t4_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs, lists and tables of every section."""
    return chunking.blocks(markdown(spark, sf)).select("document_id", "section_no", "block_no", "block")


@query()
def t6_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all pages; packing blocks with overlap is a fold, so it is tested against a model instead of SQL."""
    return chunking.chunk_documents(markdown(spark, sf))


@query(
    _sql(
        f"""SELECT doc_id, CASE WHEN title <> '' AND ends_with(c, title) THEN rtrim(left(c, len(c) - len(title))) ELSE c END AS cleaned FROM (
            SELECT doc_id, coalesce(title, '') AS title, trim(regexp_replace(regexp_replace(text, 'MAC[0-9]+(?:true|false)', ' ', 'g'), '{WS}+', ' ', 'g')) AS c FROM documents WHERE text IS NOT NULL)"""
    )
)
def s4_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' texts without macro remains and repeated titles."""
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", clean_page(F.col("text"), F.coalesce("title", F.lit(""))).alias("cleaned"))


# --- extraction --------------------------------------------------------------------------------------------------

_CASE_TYPE = "CASE " + " ".join(f"WHEN last = '{w}' THEN '{t}'" for w, t in ONTOLOGY.keywords.items()) + " END"
_CASE_DOMAIN = "CASE " + " ".join(f"WHEN bare = '{w}' THEN '{t}'" for w, t in ONTOLOGY.domain_terms.items()) + " END"
_TECH = ", ".join(f"'{t.lower()}'" for t in ONTOLOGY.technologies)
_PHRASES = f"""
    found AS (SELECT chunk_id, document, regexp_extract_all(content, '{entities.PHRASE}') AS l FROM spelt),
    rawp AS (SELECT chunk_id, document, CAST(i - 1 AS INTEGER) AS pos, l[i] AS raw FROM found, unnest(range(1, len(l) + 1)) AS u(i)),
    phrases AS (SELECT * FROM (SELECT chunk_id, document, pos, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(raw, '{WS}+', ' ', 'g')),
        '{entities._LEAD}', '')), '{entities._TRAIL}', '')) AS phrase FROM rawp) WHERE phrase <> '')"""
_RAW = f"""{_PHRASES},
    parts AS (SELECT *, regexp_replace(string_split(phrase, ' ')[-1], '[.,;:]+$', '') AS bare, string_split(phrase, ' ')[-1] AS tok FROM phrases),
    lasts AS (SELECT *, lower(bare) AS last, instr(phrase, ' ') > 0 AS several, upper(tok) = tok AND lower(tok) <> tok AND len(tok) BETWEEN 2 AND 6 AS acronym,
        lower(phrase) IN ({_TECH}) OR lower(bare) IN ({_TECH}) AS known FROM parts),
    kinded AS (SELECT *, {_CASE_TYPE} AS kind FROM lasts),
    typed AS (SELECT chunk_id, document, pos, phrase AS name, CASE WHEN kind IS NOT NULL THEN CASE WHEN kind <> 'Document' AND (several OR acronym OR known) THEN kind END
        ELSE coalesce({_CASE_DOMAIN}, CASE WHEN known THEN 'Technology' END) END AS type FROM kinded),
    topics AS (SELECT chunk_id, document, -1 AS pos, {_strip("string_split(coalesce(section_path, ''), ' > ')[-1]")} AS name, 'Topic' AS type FROM live_chunks),
    every AS (SELECT * FROM topics WHERE name <> '' AND name IS DISTINCT FROM document UNION ALL SELECT * FROM typed WHERE type IS NOT NULL),
    raw_entities AS (SELECT chunk_id, document, min(pos) AS pos, arg_min(name, pos) AS name, type FROM every GROUP BY chunk_id, document, lower(name), type),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY lower(name), type ORDER BY document NULLS FIRST, chunk_id, pos) AS n FROM raw_entities),
    ents AS (SELECT 'entity_' || {_slug("type")} || '_' || {_slug("name")} AS id, name, type, chunk_id AS source_chunk, document, pos FROM firsts WHERE n = 1),
    one_ent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY document DESC NULLS LAST, source_chunk DESC, pos DESC, name DESC) AS n FROM ents) WHERE n = 1),
    found_in AS (SELECT chunk_id, document, 'entity_' || {_slug("type")} || '_' || {_slug("name")} AS entity_id, min(pos) AS pos FROM raw_entities GROUP BY ALL)"""


@query(_sql("SELECT chunk_id, pos, phrase FROM phrases", _PHRASES))
def x1_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate names in every chunk."""
    return entities.phrases(live_chunks(spark, sf)).select("chunk_id", "pos", "phrase")


@query(_sql("SELECT chunk_id, pos, name, type FROM raw_entities", _RAW))
def x4_classified(spark: SparkSession, sf: str) -> DataFrame:
    """Typed names of every chunk, each once."""
    return entities.raw_entities(live_chunks(spark, sf), ONTOLOGY).select("chunk_id", "pos", "name", "type")


@query(_sql("SELECT id, name, type, source_chunk FROM ents", _RAW))
def x7_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of the corpus."""
    return entities.entities(entities.raw_entities(live_chunks(spark, sf), ONTOLOGY)).drop("first")


@query(_sql("SELECT chunk_id, entity_id FROM found_in", _RAW))
def x8_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of entities in chunks."""
    return entities.mentions(entities.raw_entities(live_chunks(spark, sf), ONTOLOGY)).select("chunk_id", "entity_id")


@query(_sql(f"SELECT id, 'entity_' || {_slug('type')} || '_' || {_slug('name')} AS entity_id FROM live_entities WHERE type IS NOT NULL AND name IS NOT NULL"))
def x9_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids made from the types and names of the given entities."""
    from graphloom.functions.text import entity_id

    return live_entities(spark, sf).where("type is not null and name is not null").select("id", entity_id(F.col("type"), F.col("name")).alias("entity_id"))


@query(_sql("SELECT f.chunk_id, coalesce(n, 0) AS n_mentions, coalesce(n, 0) < 3 AS to_model FROM live_chunks f LEFT JOIN (SELECT chunk_id, count(*) AS n FROM found_in GROUP BY 1) m ON m.chunk_id = f.chunk_id", _RAW))
def x13_route(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks in which the rules find fewer than three entities."""
    c = live_chunks(spark, sf)
    return entities.route(c, entities.mentions(entities.raw_entities(c, ONTOLOGY)), 3).select("chunk_id", "n_mentions", "to_model")


@query(_sql("SELECT id, name, type, source_chunk FROM one_ent WHERE id NOT IN (SELECT id FROM live_entities) UNION ALL SELECT id, name, type, source_chunk FROM live_entities", _RAW))
def x14_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Given entities together with those found by rules, one row an id, the given ones first."""
    own = entities.one_per_id(entities.entities(entities.raw_entities(live_chunks(spark, sf), ONTOLOGY)))
    return entities.merge(live_entities(spark, sf), own)


_SENT = f"""
    sents AS (SELECT chunk_id, document, CAST(i - 1 AS INTEGER) AS sentence_no, l[i] AS sentence FROM (
        SELECT chunk_id, document, list_filter(string_split(regexp_replace(trim(regexp_replace(content, '{WS}+', ' ', 'g')), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS l
        FROM live_chunks), unnest(range(1, len(l) + 1)) AS u(i))"""
_TRIGGERS = ", ".join(f"('{k}', '{t}')" for k, t in ONTOLOGY.triggers)
_RELS = f"""{_RAW}, {_SENT},
    trig AS (SELECT * FROM (VALUES {_TRIGGERS}) AS v(kind, t)),
    hit AS (SELECT chunk_id, document, sentence_no, kind, t, string_split(lower(sentence), t) AS p FROM sents JOIN trig ON contains(lower(sentence), t)),
    spans AS (SELECT chunk_id, document, sentence_no, kind, s AS start, s + len(t) AS "end" FROM (
        SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + (i - 1) * len(t) AS INTEGER) AS s FROM hit, unnest(range(1, len(p))) AS u(i))),
    placed AS (SELECT s.chunk_id, s.document, s.sentence_no, m.entity_id, m.pos AS seq, CAST(instr(lower(s.sentence), lower(e.name)) - 1 AS INTEGER) AS place
        FROM sents s JOIN found_in m ON m.chunk_id = s.chunk_id JOIN one_ent e ON e.id = m.entity_id WHERE contains(lower(s.sentence), lower(e.name))),
    places AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY chunk_id, document, sentence_no) AS n FROM placed) WHERE n > 1),
    pairs AS (SELECT s.chunk_id, s.document, s.sentence_no, s.kind, s.start,
        arg_max(entity_id, {{'a': place, 's': -seq, 'e': entity_id}}) FILTER (place < s.start) AS source,
        arg_min(entity_id, {{'a': place, 's': seq, 'e': entity_id}}) FILTER (place >= s."end") AS target
        FROM spans s JOIN places p ON p.chunk_id = s.chunk_id AND p.sentence_no = s.sentence_no AND p.document IS NOT DISTINCT FROM s.document
        GROUP BY s.chunk_id, s.document, s.sentence_no, s.kind, s.start)"""


@query(_sql("SELECT chunk_id, sentence_no, sentence FROM sents", _SENT))
def r1_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every chunk."""
    return relations.chunk_sentences(live_chunks(spark, sf)).select("chunk_id", "sentence_no", "sentence")


@query(_sql('SELECT chunk_id, sentence_no, kind, start AS span_start, CAST("end" AS INTEGER) AS span_end FROM spans', _RELS))
def r2_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """Relationship triggers in every sentence."""
    spans = relations.trigger_spans(relations.chunk_sentences(live_chunks(spark, sf)), ONTOLOGY)
    return spans.select("chunk_id", "sentence_no", "kind", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def _extracted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "extracted")
    c = scratch.cut(live_chunks(spark, sf))
    raw = scratch.cut(entities.raw_entities(c, ONTOLOGY))
    return c, entities.one_per_id(entities.entities(raw)), entities.mentions(raw)


@query(_sql("SELECT chunk_id, sentence_no, entity_id, place FROM places", _RELS))
def r3_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Places of entities in sentences that name two or more."""
    c, ents, found = _extracted(spark, sf)
    return relations.positions(relations.chunk_sentences(c), found, ents).select("chunk_id", "sentence_no", "entity_id", F.col("at").alias("place"))


@query(
    _sql(
        "SELECT source, relationship, target, source_chunk FROM (SELECT source, kind AS relationship, target, chunk_id AS source_chunk, row_number() OVER (PARTITION BY source, kind, target ORDER BY document NULLS FIRST, chunk_id) AS n FROM pairs WHERE source <> target) WHERE n = 1",
        _RELS,
    )
)
def r5_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships that the rules find."""
    c, ents, found = _extracted(spark, sf)
    return relations.extract_relationships(c, ents, found, ONTOLOGY)


# --- candidates --------------------------------------------------------------------------------------------------


@query(_sql("SELECT e.id, coalesce(n, 0) AS n_mentions, round(least(1.0, coalesce(n, 0) / 10.0), 2)::DOUBLE AS confidence_score FROM live_entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM mentions GROUP BY 1) m ON m.entity_id = e.id"))
def a2_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions and confidence of every entity."""
    return candidates.mention_counts(live_entities(spark, sf), mention_rows(spark, sf))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return mention_rows(spark, sf).select(F.col("entity_id").alias("id"), "chunk_id", F.col("chunk_id").alias("seq"))


@query(
    _sql(
        f"""SELECT id, list(snippet ORDER BY n) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first) AS n FROM (
            SELECT m.entity_id AS id, s.snippet, min(m.chunk_id) AS first FROM mentions m JOIN (SELECT chunk_id, {_snippet("content")} AS snippet FROM live_chunks) s
            ON s.chunk_id = m.chunk_id WHERE snippet <> '' GROUP BY 1, 2)) WHERE n <= 3 GROUP BY id"""
    )
)
def a3_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The first three different snippets that mention an entity."""
    return candidates.evidence(_links(spark, sf), live_chunks(spark, sf), "id")


@query(
    _sql(
        """SELECT m.id, coalesce(d.docs, []) AS source_documents, m.chunks AS source_chunks FROM (SELECT entity_id AS id, list(chunk_id ORDER BY chunk_id) AS chunks FROM mentions GROUP BY 1) m
        LEFT JOIN (SELECT id, list(document ORDER BY first) AS docs FROM (SELECT entity_id AS id, document, min(m.chunk_id) AS first FROM mentions m JOIN live_chunks c ON c.chunk_id = m.chunk_id GROUP BY 1, 2) GROUP BY id) d ON d.id = m.id"""
    )
)
def a4_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and chunks of every mentioned entity."""
    return candidates.sources(_links(spark, sf), live_chunks(spark, sf), "id")


_CASE_MEANING = "CASE term " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in ONTOLOGY.ambiguous_terms.items()) + " ELSE []::VARCHAR[] END"
_TERMS = list(ONTOLOGY.ambiguous_terms)


@query(_sql(f"SELECT id, {_CASE_MEANING} AS possible_meanings FROM (SELECT id, list_filter(string_split_regex(lower(name), '{WS}+'), lambda w: list_contains({_TERMS}, w))[1] AS term FROM live_entities WHERE name IS NOT NULL)"))
def a6_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Meanings of ambiguous names."""
    return live_entities(spark, sf).where("name is not null").select("id", candidates.possible_meanings(F.col("name"), ONTOLOGY).alias("possible_meanings"))


@query(_sql("SELECT id, name, type FROM live_entities WHERE id NOT IN (SELECT id FROM cand WHERE status IN ('APPROVED', 'REJECTED', 'MERGED'))"))
def a8_preserve(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that aren't decided yet."""
    return candidates.undecided(live_entities(spark, sf).select("id", "name", "type"), candidate_rows(spark, sf), review.DECIDED)


@query(_sql("SELECT 'rel__' || source || '__' || relationship || '__' || target AS id, source, relationship, target, count(*) AS n_occurrences FROM edge_rows GROUP BY ALL"))
def a9_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships with their number of occurrences."""
    return candidates.group_relationships(edge_rows(spark, sf))


@query(
    _sql(
        """, scores AS (SELECT e.id, round(least(1.0, coalesce(n, 0) / 10.0), 2)::DOUBLE AS s FROM live_entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM mentions GROUP BY 1) m ON m.entity_id = e.id)
        SELECT source, relationship, target, round((coalesce(a.s, 0.5) + coalesce(b.s, 0.5)) / 2, 2)::DOUBLE AS confidence_score
        FROM edges e LEFT JOIN scores a ON a.id = e.source LEFT JOIN scores b ON b.id = e.target"""
    )
)
def a10_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of every relationship from its ends."""
    scores = candidates.mention_counts(live_entities(spark, sf), mention_rows(spark, sf))
    return candidates.relationship_confidence(edges(spark, sf), scores).select("source", "relationship", "target", "confidence_score")


@query()
def a13_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Whole candidate rows of the entities that aren't decided; their parts are checked one by one."""
    m = mention_rows(spark, sf).join(live_chunks(spark, sf).select("chunk_id", "document"), "chunk_id").withColumn("pos", F.lit(0))
    return candidates.build_entities(live_entities(spark, sf), m, live_chunks(spark, sf), NOW, ONTOLOGY, candidate_rows(spark, sf))


# --- graph -------------------------------------------------------------------------------------------------------


@query(_sql(f"SELECT document_id AS child_id, parent_page_id AS parent_id FROM docs WHERE parent_page_id IS NOT NULL AND {_strip('parent_page_id')} <> ''"))
def g4_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the page tree."""
    return graph.hierarchy_edges(documents(spark, sf))


@query(
    _sql(
        """SELECT document_id AS source_id, parent_page_id AS target_id, 'Next step' AS answer_label, parent_page_id IN (SELECT document_id FROM docs) AS known FROM docs WHERE regexp_full_match(parent_page_id, '[0-9]+')
        UNION ALL SELECT document_id, document_id, 'Again', true FROM docs WHERE regexp_full_match(parent_page_id, '[0-9]+') AND regexp_full_match(document_id, '[0-9]+')"""
    )
)
def g5_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links between pages found in their texts; as the given pages hold none, links to the parent and the page itself are planted."""
    base = "https://pages.example/wiki/pages"
    link = lambda label, c: F.concat(F.lit(f"smallblue {label} {base}/"), F.col(c), F.lit("/Title"))
    digits = F.col("parent_page_id").rlike("^[0-9]+$")
    own = F.when(F.col("document_id").rlike("^[0-9]+$"), link("Again", "document_id")).otherwise("")
    planted = F.when(digits, F.concat(F.lit("Text before "), link("Next step", "parent_page_id"), F.lit("\n"), own)).otherwise("")
    d = documents(spark, sf).join(markdown(spark, sf), "document_id", "left")
    return graph.link_candidates(d.select("document_id", F.concat(F.coalesce("markdown", F.lit("")), F.lit("\n"), planted).alias("markdown")))


def _graph(spark: SparkSession, sf: str) -> graph.Graph:
    docs = documents(spark, sf).join(markdown(spark, sf), "document_id", "left")
    return graph.build_graph(docs, live_chunks(spark, sf), live_entities(spark, sf), mention_rows(spark, sf), edges(spark, sf))


_LOADED = f"""
    has_chunk AS (SELECT document AS document_id, chunk_id FROM live_chunks),
    tree AS (SELECT document_id AS child_id, parent_page_id AS parent_id FROM docs WHERE parent_page_id IS NOT NULL AND {_strip("parent_page_id")} <> ''),
    submitted AS (
        SELECT 'documents' AS kind, (SELECT count(*) FROM docs) AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM live_chunks) UNION ALL SELECT 'entities', (SELECT count(*) FROM live_entities)
        UNION ALL SELECT 'has_chunk', (SELECT count(*) FROM has_chunk) UNION ALL SELECT 'mentions', (SELECT count(*) FROM mentions)
        UNION ALL SELECT 'relationships', (SELECT count(*) FROM edges) UNION ALL SELECT 'hierarchy', (SELECT count(*) FROM tree) UNION ALL SELECT 'links', 0),
    effective AS (
        SELECT 'documents' AS kind, (SELECT count(*) FROM docs) AS n UNION ALL SELECT 'chunks', (SELECT count(*) FROM live_chunks) UNION ALL SELECT 'entities', (SELECT count(*) FROM live_entities)
        UNION ALL SELECT 'has_chunk', (SELECT count(*) FROM has_chunk WHERE document_id IN (SELECT document_id FROM docs))
        UNION ALL SELECT 'mentions', (SELECT count(*) FROM mentions WHERE chunk_id IN (SELECT chunk_id FROM live_chunks) AND entity_id IN (SELECT id FROM live_entities))
        UNION ALL SELECT 'relationships', (SELECT count(*) FROM edges WHERE relationship IN ({", ".join(f"'{t}'" for t in RELATIONSHIP_TYPES)}) AND source IN (SELECT id FROM live_entities) AND target IN (SELECT id FROM live_entities))
        UNION ALL SELECT 'hierarchy', (SELECT count(*) FROM tree WHERE parent_id IN (SELECT document_id FROM docs)) UNION ALL SELECT 'links', 0)"""


@query(_sql("SELECT kind, n AS n_rows FROM submitted", _LOADED))
def g6_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the graph's tables."""
    return graph.stats(_graph(spark, sf))


@query(_sql("SELECT s.kind, s.n AS n_submitted, e.n AS n_effective FROM submitted s JOIN effective e ON e.kind = s.kind", _LOADED))
def k16_load_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Rows submitted to the graph and rows in it."""
    return graph.load_stats(_graph(spark, sf))


@query(_sql("SELECT id, survivor FROM merges"))
def g7_merge_map(spark: SparkSession, sf: str) -> DataFrame:
    """Merged candidates and their approved survivors."""
    return graph.merge_map(candidate_rows(spark, sf))


def _resolved(status: str, live: str) -> str:
    return f"""resolved AS (SELECT r.id, coalesce(a.survivor, r.source_entity) AS source_entity, r.relationship_type, coalesce(b.survivor, r.target_entity) AS target_entity, r.confidence_score
        FROM cand_rels r LEFT JOIN merges a ON a.id = r.source_entity LEFT JOIN merges b ON b.id = r.target_entity WHERE r.status {status}),
    live AS (SELECT * FROM cand WHERE status {live}),
    kept AS (SELECT * FROM resolved WHERE source_entity <> target_entity AND source_entity IN (SELECT id FROM live) AND target_entity IN (SELECT id FROM live))"""


@query(_sql("SELECT id, name, entity_type AS type, coalesce(source_chunks[1], '') AS source_chunk FROM live", _resolved("<> 'REJECTED'", "NOT IN ('REJECTED', 'MERGED')")))
def g9_candidate_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of the candidate graph."""
    return graph.candidate_graph(candidate_rows(spark, sf), candidate_relationships(spark, sf))[0]


@query(_sql("SELECT source_entity AS source, relationship_type AS relationship, target_entity AS target FROM kept", _resolved("<> 'REJECTED'", "NOT IN ('REJECTED', 'MERGED')")))
def g9_candidate_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships of the candidate graph."""
    return graph.candidate_graph(candidate_rows(spark, sf), candidate_relationships(spark, sf))[2]


@query(_sql("SELECT source_entity AS source, relationship_type AS relationship, target_entity AS target, 'approved_ontology' AS source_chunk FROM kept", _resolved("= 'APPROVED'", "= 'APPROVED'")))
def g10_approved_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships of the approved graph."""
    return graph.approved_graph(candidate_rows(spark, sf), candidate_relationships(spark, sf), mention_rows(spark, sf))[2]


@query(_sql("SELECT m.chunk_id, m.entity_id FROM mentions m WHERE m.entity_id IN (SELECT id FROM cand WHERE status = 'APPROVED')"))
def g10_approved_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in the approved graph."""
    return graph.approved_graph(candidate_rows(spark, sf), candidate_relationships(spark, sf), mention_rows(spark, sf))[1]


@query(
    _sql(
        "SELECT k.id, source_entity, a.name AS source_name, relationship_type, target_entity, b.name AS target_name, k.confidence_score FROM kept k JOIN live a ON a.id = k.source_entity JOIN live b ON b.id = k.target_entity",
        _resolved("= 'APPROVED'", "= 'APPROVED'"),
    )
)
def g11_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships of the approved ontology with names."""
    return graph.ontology_tables(candidate_rows(spark, sf), candidate_relationships(spark, sf))[1]


@query(
    _sql(
        "SELECT 'category' AS kind, entity_type AS value, count(*) AS n_rows FROM live GROUP BY ALL UNION ALL SELECT 'relationship_type', relationship_type, count(*) FROM kept GROUP BY ALL",
        _resolved("= 'APPROVED'", "= 'APPROVED'"),
    )
)
def g11_ontology_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Approved entities by category and relationships by type."""
    return graph.ontology_stats(*graph.ontology_tables(candidate_rows(spark, sf), candidate_relationships(spark, sf)))


_PROPOSED = "IN ('APPROVED', 'PENDING_REVIEW', 'NEW')"
_EDIFF = f"""
    now AS (SELECT id, name AS name_after, entity_type AS type_after FROM cand WHERE status {_PROPOSED}),
    was AS (SELECT id, name AS name_before, lower(type) AS type_before FROM live_entities),
    both_sides AS (SELECT coalesce(w.id, n.id) AS id, w.id IS NOT NULL AS w, n.id IS NOT NULL AS n, name_before, type_before, name_after, type_after FROM was w FULL JOIN now n ON n.id = w.id),
    ediff AS (SELECT * FROM (SELECT b.id, CASE WHEN w AND m.survivor IS NOT NULL THEN 'merged' WHEN NOT w THEN 'added' WHEN NOT n THEN 'removed'
        WHEN name_before IS DISTINCT FROM name_after OR type_before IS DISTINCT FROM type_after THEN 'modified' END AS change, name_before, type_before, name_after, type_after, m.survivor
        FROM both_sides b LEFT JOIN merges m ON m.id = b.id) WHERE change IS NOT NULL)"""

def _entity_diff(spark: SparkSession, sf: str) -> DataFrame:
    baseline = live_entities(spark, sf).withColumn("type", F.lower("type"))
    return diff.entity_diff(baseline, candidate_rows(spark, sf))


@query(_sql("SELECT id, change, name_before, type_before, name_after, type_after, CASE WHEN change = 'merged' THEN survivor END AS survivor FROM ediff", _EDIFF))
def g13_entity_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Entities added, removed, merged or modified by the candidates."""
    return _entity_diff(spark, sf)


def _loaded_before(spark: SparkSession, sf: str, day: str) -> DataFrame:
    """The edges known from the rows loaded before a day."""
    plain = lambda c: F.nullif(F.lower(F.trim(F.col(c), F.lit(" \t"))), F.lit("")).alias(c)
    rows = table(spark, sf, "relationships").where(F.col("loaded_at") < F.lit(day).cast("timestamp_ntz"))
    rows = rows.select(plain("source"), F.upper(F.trim("relationship")).alias("relationship"), plain("target"))
    return rows.where("source is not null and target is not null and relationship is not null").distinct()


# Fixed value: the day up to which the earlier state had been loaded.
_EARLIER = "2025-07-01"
_RDIFF = f"""{_resolved(_PROPOSED, _PROPOSED)},
    nowr AS (SELECT DISTINCT source_entity AS source, relationship_type AS relationship, target_entity AS target FROM kept),
    wasr AS (SELECT DISTINCT * FROM (SELECT nullif(lower(trim(source, chr(32) || chr(9))), '') AS source, upper(trim(relationship)) AS relationship,
        nullif(lower(trim(target, chr(32) || chr(9))), '') AS target FROM relationships WHERE loaded_at < TIMESTAMP '{_EARLIER}')
        WHERE source IS NOT NULL AND target IS NOT NULL AND relationship IS NOT NULL),
    rdiff AS (SELECT *, 'added' AS change FROM (SELECT * FROM nowr EXCEPT SELECT * FROM wasr) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM wasr EXCEPT SELECT * FROM nowr))"""


@query(_sql("SELECT source, relationship, target, change FROM rdiff", _RDIFF))
def g13_relationship_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships added or removed against all that had been loaded by an earlier day."""
    return diff.relationship_diff(_loaded_before(spark, sf, _EARLIER), candidate_rows(spark, sf), candidate_relationships(spark, sf))


@query(
    _sql(
        "SELECT (SELECT CAST(coalesce(sum(CASE change WHEN 'added' THEN 1 WHEN 'modified' THEN 0 ELSE -1 END), 0) AS BIGINT) FROM ediff) AS node_delta, (SELECT CAST(coalesce(sum(CASE change WHEN 'added' THEN 1 ELSE -1 END), 0) AS BIGINT) FROM rdiff) AS relationship_delta",
        f"{_EDIFF}, {_RDIFF}",
    )
)
def g14_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Net change of the graph's size since that day."""
    return diff.deltas(_entity_diff(spark, sf), diff.relationship_diff(_loaded_before(spark, sf, _EARLIER), candidate_rows(spark, sf), candidate_relationships(spark, sf)))


def _first_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_documents").where("version = 1")
    return rows.groupBy("document_id").agg(F.max("content_hash").alias("content_hash"))


@query(
    _sql(
        """SELECT * FROM (SELECT coalesce(b.document_id, a.document_id) AS document_id, CASE WHEN b.document_id IS NULL THEN 'added' WHEN a.document_id IS NULL THEN 'removed'
        WHEN b.content_hash IS DISTINCT FROM a.content_hash THEN 'changed' END AS change
        FROM (SELECT document_id, max(content_hash) AS content_hash FROM raw_documents WHERE version = 1 GROUP BY 1) b FULL JOIN docs a ON a.document_id = b.document_id) WHERE change IS NOT NULL"""
    )
)
def g15_ingest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Pages added, removed or changed since their first version."""
    return diff.ingest_diff(_first_versions(spark, sf), documents(spark, sf))


@query(_sql("SELECT document_id FROM docs WHERE document_id NOT IN (SELECT child_id FROM tree UNION SELECT parent_id FROM tree)", _LOADED))
def g16_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that no edge touches."""
    d = documents(spark, sf)
    return diff.orphan_documents(d.select("document_id"), graph.hierarchy_edges(d), graph.link_candidates(markdown(spark, sf)).where("known"))


@query(_sql(f"SELECT document_id, document_name FROM docs WHERE NOT regexp_matches({_strip('document_name')}, '[A-Z][a-z]+ time$')"))
def g17_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose name doesn't end as agreed."""
    return diff.names_without(documents(spark, sf), "[A-Z][a-z]+ time$").select("document_id", "document_name")


# --- sinks -------------------------------------------------------------------------------------------------------


@query(_sql("SELECT document_id, version, content_hash FROM docs UNION ALL SELECT document_id, 0 AS version, NULL AS content_hash FROM (SELECT DISTINCT document_id FROM markdown) WHERE document_id NOT IN (SELECT document_id FROM docs)"))
def k3_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Pages known by their Markdown, with their rows in place of stubs."""
    stubs = table(spark, sf, "markdown").select("document_id", F.lit(0).alias("version"), F.lit(None).cast("string").alias("content_hash")).distinct()
    return merged(stubs, documents(spark, sf).select("document_id", "version", "content_hash"), ("document_id",))


@query(_sql("SELECT document_id, max(version) AS version FROM raw_documents WHERE document_id IS NOT NULL GROUP BY 1"))
def k7_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Of all rows of a page the last one of the batch."""
    from graphloom.sources.sinks import last_per_key

    return last_per_key(table(spark, sf, "raw_documents").where("document_id is not null"), ("document_id",), "version").select("document_id", "version")


@query(_sql("SELECT id, nullif(regexp_replace(type, '[^A-Za-z0-9_]', '', 'g'), '') AS label FROM live_entities"))
def k10_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of entities."""
    return live_entities(spark, sf).select("id", label_of(F.col("type")).alias("label"))


@query(_sql("SELECT chunk_id, entity_id FROM mentions WHERE chunk_id IN (SELECT chunk_id FROM live_chunks) AND entity_id IN (SELECT id FROM live_entities)"))
def k11_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions with both ends."""
    return graph.loadable(_graph(spark, sf)).mentions


@query(_sql(f"SELECT source, relationship, target, source_chunk FROM edges WHERE relationship IN ({', '.join(repr(t) for t in RELATIONSHIP_TYPES)}) AND source IN (SELECT id FROM live_entities) AND target IN (SELECT id FROM live_entities)"))
def k12_typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships of allowed types with both ends."""
    return graph.loadable(_graph(spark, sf)).relationships


@query(_sql("SELECT source, target, x.r AS relationship, x.c AS source_chunk FROM (SELECT source, target, max({'r': relationship, 'c': source_chunk}) AS x FROM edges GROUP BY 1, 2)"))
def k15_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One relationship for each pair of entities."""
    return graph.collapse_types(edges(spark, sf))


@query(_sql("SELECT id, count(*) AS n_rows FROM entities GROUP BY id HAVING count(*) > 1 OR id IS NULL"))
def k17_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Raw entity ids that aren't unique."""
    return key_violations(table(spark, sf, "entities"), "entities")


# --- retrieval ---------------------------------------------------------------------------------------------------


@query(_sql("SELECT c.chunk_id, v.embedding_model, CAST(len(v.embedding_vector) AS INTEGER) AS dimension FROM live_chunks c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST, embedding_model DESC NULLS LAST, embedding_vector DESC NULLS LAST) AS n FROM chunk_embeddings) WHERE n = 1) v ON v.chunk_id = c.chunk_id"))
def e4_embed_join(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with the model and dimension of their last vector."""
    rows = embed.join_vectors(live_chunks(spark, sf), table(spark, sf, "chunk_embeddings"), "embedded_at")
    return rows.select("chunk_id", "embedding_model", F.size("embedding_vector").alias("dimension"))


@query("SELECT query, vec_id, round(s, 6) AS similarity, round((1 + s) / 2, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS n FROM (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE n <= 8")
def q1_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 8 vectors most similar to each whose id is divisible by 100."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    found = retrieval.top_k_each(v, q, 8, "vec_id", "embedding")
    return found.select("query", "vec_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of which a number made from the id is divisible by 100: every one is a query of its own."""
    return live_chunks(spark, sf).where("cast(conv(left(md5(chunk_id), 8), 16, 10) as bigint) % 100 = 0").select("chunk_id", "document")


_EACH = "asked AS (SELECT chunk_id FROM live_chunks WHERE CAST('0x' || left(md5(chunk_id), 8) AS BIGINT) % 100 = 0)"


@query(_sql("SELECT DISTINCT m.chunk_id, e.id AS entity_id, e.name, e.type AS entity_type FROM mentions m JOIN live_entities e ON e.id = m.entity_id WHERE m.chunk_id IN (SELECT chunk_id FROM asked)", _EACH))
def q2_mentioned(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of every hundredth chunk."""
    return retrieval.mentioned_each(mention_rows(spark, sf), live_entities(spark, sf), _asked(spark, sf))


def _asked_entities(spark: SparkSession, sf: str) -> DataFrame:
    return q2_mentioned(spark, sf).select(F.col("chunk_id").alias("query"), F.col("entity_id").alias("id"))


_STEPS = """seeds AS (SELECT DISTINCT m.chunk_id AS query, m.entity_id AS id FROM mentions m JOIN live_entities e ON e.id = m.entity_id WHERE m.chunk_id IN (SELECT chunk_id FROM asked)),
    steps AS (SELECT source AS a, target AS b, relationship AS t, row_number() OVER (ORDER BY source, relationship, target) AS e FROM edges),
    both_ways AS (SELECT * FROM steps UNION ALL SELECT b, a, t, e FROM steps WHERE a <> b)"""


@query(
    _sql(
        """SELECT query, entity_id, name, entity_type, source_name, relationship_types FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY source_name NULLS FIRST, entity_id, relationship_types) AS n FROM (
            SELECT DISTINCT q.query, n.id AS entity_id, n.name, n.type AS entity_type, s.name AS source_name, [h.t] AS relationship_types FROM seeds q JOIN both_ways h ON h.a = q.id
            JOIN live_entities s ON s.id = q.id JOIN live_entities n ON n.id = h.b WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query = q.query AND x.id = h.b))) WHERE n <= 100""",
        f"{_EACH}, {_STEPS}",
    )
)
def q3_neighbors_h1(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the entities of every hundredth chunk, 100 a chunk."""
    return retrieval.neighbors_each(live_entities(spark, sf), edges(spark, sf), _asked_entities(spark, sf), 1, 100)


@query()
def q3_neighbors_h2(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours over up to two relationships; SQL would make all trails of hubs."""
    return retrieval.neighbors_each(live_entities(spark, sf), edges(spark, sf), _asked_entities(spark, sf), 2, 100)


@query(
    _sql(
        """SELECT query, document_id, name, source_name, answer_labels FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY len(answer_labels), source_name NULLS FIRST, document_id, answer_labels) AS n FROM (
            SELECT DISTINCT h.query, d.document_id, d.document_name AS name, s.document_name AS source_name, h.labels AS answer_labels FROM (
            SELECT q.query, a.child_id AS source_id, a.parent_id AS node, [''] AS labels FROM sd q JOIN tree a ON a.child_id = q.id
            UNION ALL SELECT q.query, a.child_id, b.parent_id, ['', ''] FROM sd q JOIN tree a ON a.child_id = q.id JOIN tree b ON b.child_id = a.parent_id WHERE (a.child_id, a.parent_id) <> (b.child_id, b.parent_id)) h
        JOIN docs s ON s.document_id = h.source_id JOIN docs d ON d.document_id = h.node WHERE h.node <> h.source_id)) WHERE n <= 20""",
        f"{_EACH}, {_LOADED}, sd AS (SELECT DISTINCT chunk_id AS query, document AS id FROM live_chunks WHERE chunk_id IN (SELECT chunk_id FROM asked))",
    )
)
def q4_linked(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that the page of every hundredth chunk leads to within two steps, along the tree as the texts hold no links."""
    d = documents(spark, sf)
    links = graph.hierarchy_edges(d).select(F.col("child_id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("").alias("answer_label"))
    seeds = _asked(spark, sf).select(F.col("chunk_id").alias("query"), F.col("document").alias("id"))
    return retrieval.linked_documents_each(d.select(F.col("document_id").alias("id"), F.col("document_name").alias("name")), links, seeds, 2, 20)


@query(
    _sql(
        """SELECT query, b AS target_id, x.a AS source_id, x.t AS label, 1 AS hop FROM r1 UNION ALL SELECT query, b, x.a, x.t, 2 FROM r2""",
        f"""{_EACH}, {_STEPS},
        r1 AS (SELECT query, b, min({{'a': a, 't': t}}) AS x FROM seeds s JOIN both_ways ON a = s.id WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query = s.query AND z.id = b) GROUP BY query, b),
        r2 AS (SELECT s.query, w.b, min({{'a': w.a, 't': w.t}}) AS x FROM r1 s JOIN both_ways w ON w.a = s.b WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query = s.query AND z.id = w.b)
            AND NOT EXISTS (SELECT 1 FROM r1 z WHERE z.query = s.query AND z.b = w.b) GROUP BY s.query, w.b)""",
    )
)
def q7_breadth_first(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes reached from the entities of every hundredth chunk within two hops, each once a chunk."""
    e = edges(spark, sf).select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("relationship").alias("label"))
    return retrieval.breadth_first_each(e, _asked_entities(spark, sf), 2)


# --- summaries ---------------------------------------------------------------------------------------------------


@query(
    _sql(
        """, ok AS (SELECT id FROM cand WHERE status = 'APPROVED' UNION SELECT id FROM merges)
        SELECT id, source_entity IN (SELECT id FROM ok) AND target_entity IN (SELECT id FROM ok) AS is_ready FROM cand_rels"""
    )
)
def v5_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships of which both ends can be published."""
    return review.ready(candidate_relationships(spark, sf), candidate_rows(spark, sf)).select("id", "is_ready")


@query(_sql("SELECT c.id, CASE WHEN c.status = 'MERGED' AND c.merged_into IS NOT NULL THEN c.name || ' (merged into ' || coalesce(o.name, c.merged_into) || ')' ELSE c.name END AS display_name FROM cand c LEFT JOIN cand o ON o.id = c.merged_into"))
def v6_display(spark: SparkSession, sf: str) -> DataFrame:
    """Names as they are shown."""
    return review.display_names(candidate_rows(spark, sf))


@query(_sql("SELECT entity_type, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in review.STATUSES) + " FROM cand GROUP BY 1"))
def v7_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by type and status."""
    return review.category_pivot(candidate_rows(spark, sf))


@query(_sql("SELECT 'entity' AS kind, id, h.timestamp, h.reviewer, h.action, h.comment FROM (SELECT id, unnest(history) AS h FROM cand) ORDER BY h.timestamp DESC, kind, id, h.action, h.reviewer, h.comment LIMIT 10"))
def v8_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The latest ten entries of all histories."""
    return review.recent_activity({"entity": candidate_rows(spark, sf)})


@query(
    _sql(
        """SELECT (SELECT count(DISTINCT d) FROM (SELECT unnest(source_documents) AS d FROM cand)) AS n_documents, count(*) AS n_rows, count(*) FILTER (status IN ('APPROVED', 'REJECTED', 'MERGED')) AS n_decided,
        count(*) FILTER (status NOT IN ('APPROVED', 'REJECTED', 'MERGED')) AS n_pending, count(*) FILTER (len(possible_meanings) > 0 AND status NOT IN ('APPROVED', 'REJECTED', 'MERGED')) AS n_ambiguous FROM cand"""
    )
)
def v9_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over all candidates."""
    return review.overview(candidate_rows(spark, sf))


@query(_sql("SELECT id, status, entity_type FROM cand WHERE status IN ('NEW', 'PENDING_REVIEW') AND entity_type IN ('system', 'service')"))
def v12_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Open candidates of two types."""
    return review.filter_rows(candidate_rows(spark, sf), ["NEW", "PENDING_REVIEW"], ["system", "service"]).select("id", "status", "entity_type")


@query(_sql("SELECT source, target, coalesce(a.name, source) AS source_name, coalesce(b.name, target) AS target_name FROM (SELECT DISTINCT source, target FROM edges) e LEFT JOIN live_entities a ON a.id = source LEFT JOIN live_entities b ON b.id = target"))
def v13_named(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of related entities by name."""
    return review.named(edges(spark, sf).select("source", "target").distinct(), live_entities(spark, sf), ["source", "target"])


@query(_sql("SELECT id, name, merged_into, CAST(len(history) AS INTEGER) AS n_history FROM (SELECT id, CASE WHEN status = 'NEW' THEN upper(name) ELSE name END AS name, CASE WHEN status = 'NEW' THEN NULL ELSE merged_into END AS merged_into, CASE WHEN status = 'NEW' THEN list_append(coalesce(history, []), {'timestamp': 't', 'reviewer': 'r', 'action': 'edit', 'comment': 'c'}) ELSE coalesce(history, []) END AS history FROM cand)"))
def v1_apply_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates after an edit of all new ones."""
    rows = candidate_rows(spark, sf)
    updates = F.create_map(F.lit("name"), F.upper("name"), F.lit("merged_into"), F.lit(None).cast("string"))
    actions = rows.where("status = 'NEW'").select("id", F.lit("edit").alias("action"), F.lit("r").alias("reviewer"), F.lit("t").alias("timestamp"), F.lit("c").alias("comment"), updates.alias("updates"))
    return review.apply_actions(rows, actions).select("id", "name", "merged_into", F.size("history").alias("n_history"))


