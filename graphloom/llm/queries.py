"""Queries over the training-data operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from graphloom.llm import components, encode, leaks, names, neighbors, pieces, spans
from graphloom.scratch import Scratch


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar vectors of every usable vector."""
    return neighbors.nearest(neighbors.usable_vectors(_table(spark, sf, "chunk_embeddings")), k=5)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks of which one is among the 5 most similar of the other."""
    near = p1_nearest(spark, sf)
    return near.select(F.least("key", "other").alias("chunk_a"), F.greatest("key", "other").alias("chunk_b")).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates linked by merged_into, directly or through others, with the least id of their group."""
    candidates = _table(spark, sf, "candidate_entities").select("id", "merged_into")
    return components.connected_components(components.merge_links(candidates)).select("id", "group_id")


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose names are spellings of one thing, with the least id of their set."""
    return names.name_groups(_table(spark, sf, "candidate_entities").select("id", "name", "entity_type"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of candidates whose names mean the same thing."""
    return names.name_pairs(p4_groups(spark, sf))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.items_of(_table(spark, sf, "markdown"), "markdown", "document_id", "markdown", True).unionByName(
        pieces.items_of(_table(spark, sf, "chunks"), "chunks", "chunk_id", "content", False, "section_path")
    )


def _item_key() -> Column:
    return F.when(F.col("item_table") == "markdown", F.concat_ws("#", "item_key", "section_no")).otherwise(F.col("item_key")).alias("item_key")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of chunks and sections of markdown with more than 800 tokens."""
    items = _items(spark, sf)
    large = pieces.oversized(items).select("item", "section_no")
    return items.select("item_table", "item_key", "item").join(large, "item").select("item_table", _item_key()).distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of everything over 800 tokens, with the path of their section."""
    items = _items(spark, sf)
    scratch = Scratch(spark, "p5")
    parts = scratch.cut(pieces.section_paths(pieces.sections(items.where(F.char_length("text") > 1200))))
    large = parts.where(F.col("words") > pieces.words_within(pieces.MAX_TOKENS))
    split = pieces.split_sections(items, large.select("item", "section_no", "body", "end", "words"))
    # of a text's rows under one key the greatest path counts
    names = items.groupBy("item_table", "item_key", "item").agg(F.max("path").alias("given"))
    out = split.join(names, "item").join(large.select("item", "section_no", "section_path"), ["item", "section_no"])
    path = F.when(F.col("item_table") == "chunks", F.col("given")).otherwise(F.col("section_path"))
    return out.select("item_table", _item_key(), "item", "piece_no", path.alias("section_path"), "token_count", "start", "end", "content")


def p5_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Of everything over 800 tokens its path and the words its pieces hold, overlaps counted once; gaps and limits exceeded, which must be 0."""
    words = lambda c: F.size(F.filter(F.split(c, "[ \t\r\n]+"), lambda x: x != ""))
    w = Window.partitionBy("item_table", "item_key", "item").orderBy("piece_no")
    rows = p5_pieces(spark, sf).withColumn("before", F.lag("end").over(w))
    over = F.coalesce(words(F.expr("left(content, cast(before - start as int))")), F.lit(0))
    rows = rows.select("*", words(F.col("content")).alias("n"), over.alias("again"))
    count = lambda c: F.count_if(c)
    return rows.groupBy("item_table", "item_key", "item", "section_path").agg(
        F.sum(F.col("n") - F.col("again")).alias("words"), count(F.col("start") > F.col("before")).alias("gaps"),
        count((F.col("token_count") > 800) | (F.col("token_count") != F.floor(F.col("n") * 4 / 3))).alias("wrong_counts"), count(F.floor(F.col("again") * 4 / 3) > 100).alias("long_overlaps"),
    ).drop("item")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode_texts(_table(spark, sf, "documents").select("doc_id", "text"))


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Number of documents and tokens of the corpus."""
    return encode.count_tokens(p7_ids(spark, sf))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_spans(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "eval_items").select("item_id", "prompt"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least 14 consecutive words of an evaluation prompt."""
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked evaluation items with the number of documents and the longest stretch."""
    return leaks.leaked_items(_leaks(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each document that also stand in others, in spans of at least 300."""
    return spans.shared_lengths(spans.shared_spans(_table(spark, sf, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_nearest": p1_nearest,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_coverage": p5_coverage,
    "p7_ids": p7_ids,
    "p7_counts": p7_counts,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_found": p9_found,
}

_WORDS = "len(list_filter(string_split_regex({}, '[ \\t\\r\\n]+'), lambda x: x <> ''))"

_LEVELS = ", ".join(
    f"last_value(CASE WHEN level = {k} THEN {{'i': i, 't': title}} END IGNORE NULLS) OVER w AS h{k}, coalesce(last_value(CASE WHEN level < {k} THEN i END IGNORE NULLS) OVER w, 0) AS c{k}"
    for k in range(1, 7)
)
_COVERAGE = f"""
    WITH lines AS (
        SELECT document_id, m, i, string_split(m, chr(10))[i] AS line
        FROM (SELECT DISTINCT document_id, markdown AS m FROM markdown WHERE markdown IS NOT NULL AND document_id IS NOT NULL) d, unnest(range(1, len(string_split(m, chr(10))) + 1)) AS u(i)),
    marked AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN len(regexp_extract(line, '^#+')) END AS level FROM lines),
    titled AS (SELECT *, regexp_replace(substr(line, level + 1), '^\\s+|\\s+$', '', 'g') AS title FROM marked),
    numbered AS (SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER w AS n, {_LEVELS} FROM titled WINDOW w AS (PARTITION BY document_id, m ORDER BY i)),
    pathed AS (SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN h{k}.i > c{k} THEN h{k}.t END" for k in range(1, 7))}], lambda t: t IS NOT NULL AND t <> ''), ' > ') AS path FROM numbered),
    large AS (
        SELECT 'markdown' AS item_table, document_id || '#' || CAST(n AS BIGINT) AS item_key, max(path) AS section_path, sum({_WORDS.format("line")}) FILTER (level IS NULL) AS words FROM pathed GROUP BY document_id, m, n
        UNION ALL SELECT 'chunks', chunk_id, max(section_path), {_WORDS.format("content")} FROM chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL GROUP BY chunk_id, content)
    SELECT item_table, item_key, section_path, CAST(words AS BIGINT) AS words, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS wrong_counts, CAST(0 AS BIGINT) AS long_overlaps FROM large WHERE words > 600"""

_PHRASES = """
    said AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    asked AS (SELECT item_id, regexp_extract_all(lower(prompt), '[\\pL\\pN]+') AS w FROM eval_items WHERE prompt IS NOT NULL AND item_id IS NOT NULL),
    phrases AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 13], ' ') AS p FROM asked, unnest(range(1, len(w) - 12)) AS u(i)),
    hits AS (SELECT doc_id, item_id, i FROM (SELECT doc_id, i, array_to_string(w[i:i + 13], ' ') AS p FROM said, unnest(range(1, len(w) - 12)) AS u(i)) d JOIN phrases USING (p))"""

SQL: dict[str, str] = {
    "p5_coverage": _COVERAGE,
    "p8_found": f"WITH {_PHRASES} SELECT DISTINCT doc_id, item_id FROM hits",
    "p8_items": f"""WITH {_PHRASES},
        marked AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 14 THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY i)),
        islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS island FROM marked),
        spans AS (SELECT doc_id, item_id, max(i) - min(i) + 14 AS length FROM islands GROUP BY doc_id, item_id, island)
        SELECT item_id, count(DISTINCT doc_id) AS n_docs, CAST(max(length) AS INTEGER) AS longest FROM spans GROUP BY item_id""",
    "p9_found": """
        WITH windows AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM documents, unnest(range(1, length(text) - 298)) AS u(i) WHERE doc_id IS NOT NULL AND length(text) >= 300),
        met AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)),
        hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows SEMI JOIN met USING (h))
        SELECT doc_id, CAST(sum(least(300, i - coalesce(before, i - 300))) AS BIGINT) AS shared_chars FROM hits GROUP BY doc_id""",
    "p5_found": f"""
        WITH lines AS (
            SELECT document_id, m, i, string_split(m, chr(10))[i] AS line
            FROM (SELECT DISTINCT document_id, markdown AS m FROM markdown WHERE markdown IS NOT NULL AND document_id IS NOT NULL) d,
                unnest(range(1, len(string_split(m, chr(10))) + 1)) AS u(i)),
        marked AS (SELECT *, regexp_matches(line, '^#{{1,6}} ') AS head FROM lines),
        numbered AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY document_id, m ORDER BY i) AS n FROM marked)
        SELECT DISTINCT 'markdown' AS item_table, document_id || '#' || CAST(n AS BIGINT) AS item_key FROM numbered WHERE NOT head
        GROUP BY document_id, m, n HAVING sum({_WORDS.format("line")}) > 600
        UNION SELECT DISTINCT 'chunks', chunk_id FROM chunks WHERE content IS NOT NULL AND chunk_id IS NOT NULL AND {_WORDS.format("content")} > 600""",
    "p2_found": """
        WITH RECURSIVE ids AS (SELECT DISTINCT id FROM candidate_entities WHERE id IS NOT NULL),
        said AS (SELECT DISTINCT id AS a, lower(trim(merged_into, chr(32) || chr(9) || chr(13) || chr(10))) AS b FROM candidate_entities),
        link AS (SELECT a, b FROM said JOIN ids ON b = ids.id WHERE a <> b),
        both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
        SELECT a AS id, min(least(a, b)) AS group_id FROM reach GROUP BY a""",
}
