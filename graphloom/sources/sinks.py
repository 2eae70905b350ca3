"""Sinks: whole tables, upserts by key, snapshots of graphs, text files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.contracts import CONTRACTS, identifier
from graphloom.operators.graph import Graph
from graphloom.scratch import Scratch, is_local
from graphloom.sources.files import read_table


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def overwrite(df: DataFrame, root: str, table: str) -> str:
    """K1, K2: replace a table; written beside it first and swapped in, so a plan may read what it replaces."""
    spark, final = df.sparkSession, f"{root}/{table}"
    new, old = f"{final}.new-{uuid.uuid4().hex}", f"{final}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, p = _fs(spark, final)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(p):
        fs.rename(p, path(old))
    fs.rename(path(new), p)
    fs.delete(path(old), True)
    spark.catalog.refreshByPath(final)
    return final


def last_per_key(rows: DataFrame, key: tuple[str, ...], order: str | None) -> DataFrame:
    """K7: of a batch the last row of each key by ``order``."""
    if order is None:
        return rows.dropDuplicates(list(key))
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged(target: DataFrame, batch: DataFrame, key: tuple[str, ...], order: str | None = None) -> DataFrame:
    """K3, K6, K7: ``target`` with the batch's rows in place of those of equal keys, and its new ones."""
    new = last_per_key(batch, key, order)
    if order is not None and order not in target.columns:
        new = new.drop(order)
    return target.join(new.select(*key), list(key), "left_anti").select(*target.columns).unionByName(new, allowMissingColumns=True)


def upsert(batch: DataFrame, root: str, table: str, order: str | None = None) -> int:
    """Upsert into a stored table by its contract's key; the number of rows saved. An empty batch does nothing.

    The batch is written once beforehand, as the merge reads it twice. The stored rows are read and written once each.
    """
    key = CONTRACTS[table].key
    new, (n, *_) = Scratch(batch.sparkSession, "upsert").cut_state(last_per_key(batch, key, order), *key)
    if n:
        overwrite(merged(read_table(batch.sparkSession, root, table), new, key), root, table)
    return n


def merge_sql(table: str, source: str) -> str:
    """K3: MERGE statement of a contract for catalogs that support it."""
    c = CONTRACTS[table]
    on = " AND ".join(f"t.{k} = s.{k}" for k in c.key)
    cols = c.schema.names
    sets = ", ".join(f"t.{x} = s.{x}" for x in cols if x not in c.key)
    update = f"WHEN MATCHED THEN UPDATE SET {sets} " if sets else ""
    return f"MERGE INTO {identifier(table)} t USING {identifier(source)} s ON {on} {update}WHEN NOT MATCHED THEN INSERT ({', '.join(cols)}) VALUES ({', '.join(f's.{x}' for x in cols)})"


def write_snapshot(graph: Graph, root: str, name: str) -> None:
    """The graph's tables below one folder, in place of the snapshot before."""
    for part, df in vars(graph).items():
        overwrite(df, f"{root}/{identifier(name)}", part)


def read_snapshot(spark: SparkSession, root: str, name: str) -> Graph | None:
    """A stored snapshot, or None."""
    fs, p = _fs(spark, f"{root}/{identifier(name)}")
    if not fs.exists(p):
        return None
    return Graph(**{k: spark.read.parquet(f"{root}/{name}/{k}") for k in Graph.__dataclass_fields__})


GRAPH_KEYS = {
    "documents": ("id",), "chunks": ("id",), "entities": ("id",), "has_chunk": ("document_id", "chunk_id"), "mentions": ("chunk_id", "entity_id"),
    "relationships": ("source", "relationship", "target"), "hierarchy": ("child_id", "parent_id"), "links": ("source_id", "target_id", "answer_label"),
}


def upsert_graph(graph: Graph, root: str, name: str) -> None:
    """Nodes and edges added to a stored graph or put in place of those of equal keys; nothing is deleted."""
    stored = read_snapshot(graph.documents.sparkSession, root, name)
    for part, key in GRAPH_KEYS.items():
        new = getattr(graph, part).dropDuplicates(list(key))
        overwrite(new if stored is None else merged(getattr(stored, part), new, key), f"{root}/{identifier(name)}", part)


def write_markdown_files(docs: DataFrame, folder: str, shared: bool = False) -> DataFrame:
    """One ``.md`` file a document, written by the executors; document_id and markdown_path of each.

    On a cluster ``folder`` must be mounted on all executors, which the caller says by ``shared``; else ValueError.
    """
    if not (shared or is_local(docs.sparkSession)):
        raise ValueError("on a cluster the files need a folder that all executors share")

    def run(batches):
        import pathlib

        import pandas as pd

        pathlib.Path(folder).mkdir(parents=True, exist_ok=True)
        for b in batches:
            paths = []
            for i, text in zip(b.document_id, b.markdown, strict=True):
                p = pathlib.Path(folder, f"{str(i).replace('/', '_')}.md")
                p.write_text(text or "", encoding="utf-8")
                paths.append(str(p))
            yield pd.DataFrame({"document_id": b.document_id, "markdown_path": paths})

    return docs.select("document_id", "markdown").mapInPandas(run, "document_id string, markdown_path string")
