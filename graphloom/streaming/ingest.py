"""Incremental ingest: new or changed documents as a stream, upserted by micro-batches (an extension of the pipeline)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.contracts import CONTRACTS
from graphloom.operators import chunking
from graphloom.scratch import Scratch
from graphloom.sources.files import read_table
from graphloom.sources.sinks import merged, overwrite


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of the markdown contract from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(CONTRACTS["markdown"].schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_chunks(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: of each document the latest version of a batch is kept, unless a later one is stored, and its chunks take the place of all it had.

    Running a batch again gives the same tables, so delivery at least once is enough.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = read_table(spark, root, "markdown")
        latest = Window.partitionBy("document_id").orderBy(*[F.desc_nulls_last(c) for c in ("version", "ingested_at", "markdown")])
        last = batch.where("document_id is not null").withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        # what arrives after a later version changes nothing
        newer = stored.select("document_id", F.col("version").alias("_v"))
        last = last.join(newer, "document_id", "left").where("_v is null or coalesce(version, -1) >= _v").select(batch.columns)
        last = Scratch(spark, "stream").cut(last)
        old = read_table(spark, root, "chunks")
        kept = old.join(last.select(F.col("document_id").alias("document")), "document", "left_anti").select(*old.columns)
        overwrite(kept.unionByName(chunking.chunk_documents(last)), root, "chunks")
        overwrite(merged(stored, last, ("document_id",)), root, "markdown")

    return run


def start(spark: SparkSession, folder: str, root: str, checkpoint: str) -> StreamingQuery:
    """Process what is in the folder now and stop; called again it goes on where it ended."""
    return document_stream(spark, folder).writeStream.foreachBatch(upsert_chunks(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
