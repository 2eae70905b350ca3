"""Embedding of chunks through injected clients, and the join of vectors onto chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def embed_chunks(chunks: DataFrame, embedder: Embedder, model: str, batch: int = 64) -> DataFrame:
    """chunk_id, document, embedding_vector, embedding_model: one row a chunk, ``batch`` texts a call.

    An error of the embedder fails the task, which Spark repeats. Null contents are embedded as empty texts.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.content.fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            yield pd.DataFrame({"chunk_id": part.chunk_id, "document": part.document, "embedding_vector": vectors, "embedding_model": model})

    return chunks.select("chunk_id", "document", "content").mapInPandas(run, "chunk_id string, document string, embedding_vector array<float>, embedding_model string")


def no_embedding(chunks: DataFrame) -> DataFrame:
    """Rows without vectors and model."""
    return chunks.select("chunk_id", "document", F.lit(None).cast("array<float>").alias("embedding_vector"), F.lit(None).cast("string").alias("embedding_model"))


def hashing_embedder(size: int = 64) -> Embedder:
    """A deterministic embedder for tests: signed counts of hashed words, unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(size)
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return run


def latest_vectors(vectors: DataFrame, order: str | None = "embedded_at") -> DataFrame:
    """One row a chunk: the last by ``order``; of equal ones the greatest model and vector."""
    by = [F.col(order).alias("o")] if order else []
    return vectors.groupBy("chunk_id").agg(F.max(F.struct(*by, "embedding_model", "embedding_vector")).alias("x")).select("chunk_id", "x.embedding_model", "x.embedding_vector")


def join_vectors(chunks: DataFrame, vectors: DataFrame, order: str | None = None) -> DataFrame:
    """Chunks with their vectors, null where there is none."""
    last = latest_vectors(vectors, order)
    return chunks.join(last, "chunk_id", "left")
