"""Queries over the general operators on the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import hierarchy, orphans


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references of relationships and entities."""
    entities = table(spark, sf, "entities").select("id", "source_chunk", "loaded_at", "is_deleted")
    relationships = table(spark, sf, "relationships").select("source", "target", "loaded_at")
    chunks = table(spark, sf, "chunks").select("chunk_id", "loaded_at", "is_deleted")
    return orphans.orphan_references(
        [
            orphans.Reference("relationships", relationships, "source", "entities", entities, "id"),
            orphans.Reference("relationships", relationships, "target", "entities", entities, "id"),
            orphans.Reference("entities", entities, "source_chunk", "chunks", chunks, "chunk_id"),
        ]
    )


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan keys counted per table, field, month and reason."""
    return orphans.orphan_report(p3_found(spark, sf))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.latest_pages(table(spark, sf, "raw_documents"), "document_id", "parent_page_id", "version", "space_key")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root, depth and number of descendants of every page."""
    return hierarchy.hierarchy(_pages(spark, sf))


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path of ids from the root of every page."""
    links = _pages(spark, sf)
    return hierarchy.paths(links, hierarchy.hierarchy(links))


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All pages beneath every page, loops included."""
    links = _pages(spark, sf)
    return hierarchy.all_descendants(links, hierarchy.hierarchy(links))


_P3_FOUND = """
    SELECT * FROM (
    WITH parents AS (
        SELECT 'entities' AS parent, nullif(lower(trim(id, chr(32) || chr(9))), '') AS key, loaded_at, is_deleted FROM entities
        UNION ALL SELECT 'chunks', nullif(lower(trim(chunk_id, chr(32) || chr(9))), ''), loaded_at, is_deleted FROM chunks),
    state AS (
        SELECT parent, key, min(loaded_at) AS first_at, arg_max(coalesce(is_deleted, false), (loaded_at, coalesce(is_deleted, false))) AS gone
        FROM parents WHERE key IS NOT NULL GROUP BY parent, key),
    refs AS (
        SELECT 'relationships' AS ref_table, 'source' AS ref_column, 'entities' AS parent, source AS k, loaded_at FROM relationships
        UNION ALL SELECT 'relationships', 'target', 'entities', target, loaded_at FROM relationships
        UNION ALL SELECT 'entities', 'source_chunk', 'chunks', source_chunk, loaded_at FROM entities),
    keyed AS (SELECT ref_table, ref_column, parent, nullif(lower(trim(k, chr(32) || chr(9))), '') AS ref_key, loaded_at FROM refs),
    judged AS (
        SELECT ref_table, ref_column, ref_key, strftime(r.loaded_at, '%Y-%m') AS ref_month,
            CASE WHEN s.key IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_at > r.loaded_at THEN 'late' END AS reason
        FROM keyed r LEFT JOIN state s ON s.parent = r.parent AND s.key = r.ref_key WHERE ref_key IS NOT NULL)
    SELECT DISTINCT * FROM judged WHERE reason IS NOT NULL)"""

_PAGES = """
    latest AS (
        SELECT document_id AS id, max({'v': version, 'p': trim(parent_page_id, chr(32) || chr(9) || chr(13) || chr(10)), 'n': space_key}) AS x
        FROM raw_documents WHERE document_id IS NOT NULL GROUP BY document_id),
    up AS (SELECT l.id, p.id AS parent FROM latest l LEFT JOIN latest p ON p.id = l.x.p)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p6_found": p6_found,
    "p6_paths": p6_paths,
    "p6_descendants": p6_descendants,
}

SQL: dict[str, str] = {
    "p3_found": _P3_FOUND,
    "p3_report": f"SELECT ref_table, ref_column, ref_month, reason, count(*) AS n_keys FROM ({_P3_FOUND}) GROUP BY ALL",
    "p6_found": f"""
        WITH RECURSIVE {_PAGES},
        above AS (
            SELECT id, parent AS a, 1 AS d FROM up WHERE parent IS NOT NULL
            UNION SELECT above.id, up.parent, d + 1 FROM above JOIN up ON up.id = above.a WHERE up.parent IS NOT NULL AND d < 200),
        pairs AS (SELECT id, a, min(d) AS d FROM above GROUP BY id, a),
        on_loop AS (SELECT id FROM pairs WHERE id = a),
        loop_root AS (SELECT p.id, min(p.a) AS root FROM pairs p JOIN on_loop l ON l.id = p.a GROUP BY p.id),
        tree_root AS (SELECT p.id, p.a AS root, p.d FROM pairs p JOIN up ON up.id = p.a AND up.parent IS NULL),
        below AS (SELECT a AS id, count(*) FILTER (WHERE id <> a) AS n FROM pairs GROUP BY a)
        SELECT u.id AS document_id, coalesce(l.root, t.root, u.id) AS root_id,
            CAST(CASE WHEN o.id IS NOT NULL THEN -1 WHEN l.id IS NOT NULL THEN -2 ELSE coalesce(t.d, 0) END AS INTEGER) AS tree_depth,
            coalesce(b.n, 0) AS n_descendants
        FROM up u LEFT JOIN loop_root l ON l.id = u.id LEFT JOIN on_loop o ON o.id = u.id
        LEFT JOIN tree_root t ON t.id = u.id LEFT JOIN below b ON b.id = u.id""",
    "p6_paths": f"""
        WITH RECURSIVE {_PAGES},
        above AS (
            SELECT id, parent AS a, 1 AS d FROM up WHERE parent IS NOT NULL
            UNION SELECT above.id, up.parent, d + 1 FROM above JOIN up ON up.id = above.a WHERE up.parent IS NOT NULL AND d < 200),
        on_loop AS (SELECT DISTINCT id FROM above WHERE id = a),
        down AS (
            SELECT u.id AS document_id, u.id AS path FROM up u WHERE u.parent IS NULL OR u.id IN (SELECT id FROM on_loop)
            UNION ALL SELECT u.id, d.path || ' > ' || u.id FROM down d JOIN up u ON u.parent = d.document_id WHERE u.id NOT IN (SELECT id FROM on_loop))
        SELECT document_id, path FROM down""",
    "p6_descendants": f"""
        WITH RECURSIVE {_PAGES},
        above AS (
            SELECT id, parent AS a, 1 AS d FROM up WHERE parent IS NOT NULL
            UNION SELECT above.id, up.parent, d + 1 FROM above JOIN up ON up.id = above.a WHERE up.parent IS NOT NULL AND d < 200)
        SELECT a AS document_id, id AS descendant_id, CAST(min(d) AS INTEGER) AS levels FROM above WHERE a <> id GROUP BY a, id""",
}
