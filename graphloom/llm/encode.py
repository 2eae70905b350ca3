"""Encoding of texts with a public byte-level BPE vocabulary by forced-boundary splitting.

A pair of bytes that stands next to each other inside no token can't be joined by any merge, so a text may be cut
there. Of these pairs, those are used at which the splitting pattern always ends a word too (between ASCII letters,
digits, punctuation and white space, in the directions that need no look ahead). The fragments repeat far more than
whole texts do: each different one of a batch is encoded once, and the ids are gathered in text order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every function that needs one.
VOCABULARIES = "/opt/tokenizers"
#: The splitting pattern of byte_bpe_50k and byte_bpe_multi_50k; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text handled at once, and entries of a worker's cache of encoded fragments.
BLOCK, CACHE = 1 << 22, 1 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def certain_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256 flags: a text may be cut between the two bytes, whatever stands around them."""
    inside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        b = np.frombuffer(token, dtype=np.uint8)
        inside[b[:-1], b[1:]] = True
    kind = np.zeros(256, dtype=np.int8)  # 0: never cut at
    for c in range(33, 127):
        kind[c] = 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3
    kind[ord("'")] = 0  # contractions join an apostrophe with letters
    kind[[9, 10, 13, 32]] = 4
    a, b = kind[:, None], kind[None, :]
    return (a != b) & (a > 0) & (a < 4) & (b > 0) & ~inside


class Encoder:
    """Ids of texts, one worker's copy."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        ranks = read_ranks(vocabulary)
        self.cuts = certain_cuts(ranks)
        self.encode = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, list[int]] = {}

    def batch(self, texts: pa.Array) -> pa.ListArray:
        """A list of ids for each text; empty for a null or empty one."""
        if texts.null_count:
            texts = texts.fill_null("")
        texts = pa.concat_arrays([texts.cast(pa.string())])
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        if not len(raw):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        bounds = offsets - offsets[0]
        cut = np.empty(len(raw), dtype=bool)
        cut[0] = True
        cut[1:] = self.cuts[raw[:-1], raw[1:]]
        cut[bounds[:-1][bounds[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut).astype(np.int32)
        frag = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(len(raw)))), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = frag.dictionary_encode()
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, encode = self.cache, self.encode
        ids: list[list[int]] = []
        for f in coded.dictionary.to_pylist():
            x = cache.get(f)
            if x is None:
                x = cache[f] = encode(f)
            ids.append(x)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))
        begin = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[which]
        ends = np.cumsum(n)
        values = flat[np.repeat(begin[which] - (ends - n), n) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]
        return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values))


def _run(vocabulary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.columns
            sizes = np.cumsum(np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)))
            a = 0
            while a < len(texts):  # at least one text, then as many as fit
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BLOCK)))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), encoder.batch(texts.slice(a, b - a))], names=["doc_id", "ids"])
                a = b

    return run


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, ids (array<int>): ids of every row's text without special tokens, which count as ordinary text.

    Null and empty texts give an empty list; repeated rows and null keys stay as they are; order is free. Nothing is
    shuffled. The vocabulary (under 1 MB, of fixed size) is read by the driver and travels with the tasks.
    """
    data = Path(folder, f"{vocabulary}.tiktoken").read_bytes()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_run(data), f"doc_id {kind}, ids array<int>")


def count_tokens(encoded: DataFrame) -> DataFrame:
    """Number of texts and tokens of an encoded corpus."""
    return encoded.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n_tokens"))
