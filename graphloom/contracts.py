"""Table contracts: schema and primary key of every table that the pipeline keeps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HISTORY = "history array<struct<timestamp:string,reviewer:string,action:string,comment:string>>"
_RAW = "document_id string, document_name string, source_path string, ingested_at string, parent_page_id string, space_key string, content_hash string, version int"


@dataclass(frozen=True)
class Contract:
    """DDL of the columns and the names of the key columns."""

    ddl: str
    key: tuple[str, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


CONTRACTS: dict[str, Contract] = {
    "raw_documents": Contract(_RAW, ("document_id",)),
    "markdown": Contract(f"{_RAW}, markdown_path string, markdown string", ("document_id",)),
    "chunks": Contract("chunk_id string, document string, section_path string, content string, token_count int", ("chunk_id",)),
    "embeddings": Contract("chunk_id string, document string, embedding_vector array<float>, embedding_model string", ("chunk_id",)),
    "entities": Contract("id string, name string, type string, source_chunk string", ("id",)),
    "mentions": Contract("chunk_id string, entity_id string", ("chunk_id", "entity_id")),
    "relationships": Contract("source string, relationship string, target string, source_chunk string", ("source", "relationship", "target")),
    "candidate_entities": Contract(
        "id string, name string, entity_type string, definition string, business_meaning string, confidence_score double, status string, "
        "evidence array<string>, source_documents array<string>, source_chunks array<string>, possible_meanings array<string>, "
        f"{_HISTORY}, reviewer string, review_timestamp string, merged_into string",
        ("id",),
    ),
    "candidate_relationships": Contract(
        "id string, source_entity string, relationship_type string, target_entity string, confidence_score double, status string, "
        f"evidence array<string>, {_HISTORY}, reviewer string, review_timestamp string",
        ("id",),
    ),
    "approved_entities": Contract(
        "id string, name string, category string, definition string, business_meaning string, confidence_score double, source_documents array<string>", ("id",)
    ),
    "approved_relationships": Contract(
        "id string, source_entity string, source_name string, relationship_type string, target_entity string, target_name string, confidence_score double", ("id",)
    ),
    "has_chunk": Contract("document_id string, chunk_id string", ("document_id", "chunk_id")),
    "page_hierarchy": Contract("child_id string, parent_id string", ("child_id", "parent_id")),
    "page_links": Contract("source_id string, target_id string, answer_label string", ("source_id", "target_id", "answer_label")),
}


def identifier(name: str) -> str:
    """K5: ``name`` if it may stand in SQL text, else ValueError."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def create_table_sql(table: str, using: str = "parquet") -> str:
    """K4: CREATE TABLE statement of a contract."""
    return f"CREATE TABLE IF NOT EXISTS {identifier(table)} ({CONTRACTS[table].ddl}) USING {identifier(using)}"


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty table of a contract."""
    return spark.createDataFrame([], CONTRACTS[table].schema)


def conform(df: DataFrame, table: str, extras: bool = True) -> DataFrame:
    """Columns of the contract in order and type, absent ones null; other columns follow if ``extras``."""
    schema = CONTRACTS[table].schema
    own = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*own, *([c for c in df.columns if c not in schema.names] if extras else []))


def key_violations(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once or hold a null, with their number of rows."""
    key = CONTRACTS[table].key
    null = F.greatest(*[F.col(k).isNull() for k in key], F.lit(False))
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | null)
