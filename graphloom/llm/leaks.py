"""Evaluation texts leaking into training text, found by an FM-index over each training shard.

The alphabet is the words of the evaluation items; every other word is a separator, since no phrase holds it. Stretches
between separators that are shorter than a phrase can't hold one and are left out of the index as well. The index is a
Burrows-Wheeler transform of the remaining word ids in a wavelet tree; all phrases of all items are searched backward
at once, their places are found by walking to sampled suffix positions, and places of one item that touch are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.spans import BLOCK, _codes, _Hashes

PHRASE = 14
#: Every how many-th text position keeps its suffix position.
SAMPLE = 16
#: Words of one index, and phrases that are searched in one pass over the corpus.
INDEX_WORDS, MAX_PHRASES = 1 << 20, 1 << 20


class WaveletTree:
    """Ranks of symbols in a sequence: one level a bit, stably split by that bit, with running counts of ones."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position i."""
        lo, hi = np.zeros_like(i), i
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            set_ = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(set_, zeros + a, lo - a), np.where(set_, zeros + b, hi - b)
        return hi - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        """Symbols at positions."""
        out = np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    """Index over word ids; id 0 separates. The text ends with a separator that sorts before all others."""

    def __init__(self, words: np.ndarray, n_symbols: int) -> None:
        text = np.concatenate([words + 1, [0]]).astype(np.int64)
        n = len(text)
        rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while True:  # prefix doubling
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            rank, k = new, 2 * k
            if rank[order[-1]] == n - 1 or k >= n:
                break
        self.n = n
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 2))])
        self.tree = WaveletTree(bwt, max(1, int(n_symbols + 1).bit_length()))
        sampled = order % SAMPLE == 0
        self.sampled, self.place = np.concatenate([[0], np.cumsum(sampled)]), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each phrase (rows of word ids from 1), by backward search; empty ones have lo >= hi."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, step] + 1
            lo[live], hi[live] = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one."""
        rows, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            hit = self.sampled[r + 1] > self.sampled[r]
            out[todo[hit]] = self.place[self.sampled[r[hit]]] + steps
            todo, r = todo[~hit], r[~hit]
            c = self.tree.at(r)
            rows[todo] = self.first[c] + self.tree.rank(c, r)
            steps += 1
        return out


_ALNUM: list[np.ndarray] = []


def _word_bounds(codes: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters and digits; no run crosses the end of a text."""
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    on = np.concatenate([[False], _ALNUM[0][codes], [False]])
    starts, ends = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(on[:-1] & ~on[1:])
    if len(text_ends) > 1 and len(starts):
        inner = text_ends[:-1]
        inner = inner[(inner > 0) & (inner < len(codes))]
        split = np.unique(inner[on[inner] & on[inner + 1]])
        starts, ends = np.union1d(starts, split), np.union1d(ends, split)
    return starts, ends


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and start (in characters of the lower-case text) of every word."""
    lower = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lower), np.int64, len(lower))
    ends_of = np.cumsum(lengths)
    codes = _codes(lower)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends = _word_bounds(codes, ends_of)
    text = np.searchsorted(ends_of, starts, side="right")
    return text, _Hashes(codes).of(starts, ends), starts - (ends_of - lengths)[text]


class _Phrases:
    """Vocabulary and phrases of the items; item numbers by phrase."""

    def __init__(self, items: list[tuple[int, str]], phrase: int) -> None:
        text, hashes, _ = word_hashes([t for _, t in items])
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        rows, owners = [], []
        for k, (item, _) in enumerate(items):
            own = ids[text == k]
            for i in range(len(own) - phrase + 1):
                rows.append(own[i : i + phrase])
                owners.append(item)
        table = np.asarray(rows, np.int64).reshape(-1, phrase)
        self.phrases, number = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        order = np.argsort(number.reshape(-1), kind="stable")
        self.items = np.asarray(owners, np.int64)[order]
        self.begin = np.searchsorted(number.reshape(-1)[order], np.arange(len(self.phrases) + 1))


def _find(p: _Phrases, phrase: int, ids: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Spans in one shard: ids of its stretches with separators between, document and word number of each."""
    index = FMIndex(ids, len(p.vocabulary))
    lo, hi = index.search(p.phrases)
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    place = index.locate(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()))
    m = p.begin[which + 1] - p.begin[which]
    item = p.items[np.repeat(p.begin[which] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
    place = np.repeat(place, m)
    d, start = doc[place], at[place]
    order = np.lexsort((start, item, d))
    d, item, start = d[order], item[order], start[order]
    if not len(d):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], names=["doc_id", "item_id", "first_word", "end_word"])
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + phrase)])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(d)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(d[a]), pa.array(item[a]), pa.array(start[a].astype(np.int32)), pa.array((start[b] + phrase).astype(np.int32))],
        names=["doc_id", "item_id", "first_word", "end_word"],
    )


def _searcher(items: list[tuple[int, str]], phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Phrases(items, phrase)
        shard: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for keys, texts in _blocks(batches):
            text, h, _ = word_hashes(texts)
            if not len(h) or not len(p.phrases):
                continue
            slot = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
            ids = np.where(p.vocabulary[slot] == h, slot + 1, 0)
            first = np.searchsorted(text, np.arange(len(texts)))
            at = np.arange(len(ids)) - first[text]
            # stretches of known words within one text, at least a phrase long
            change = np.concatenate([[True], (text[1:] != text[:-1]) | ((ids[1:] == 0) != (ids[:-1] == 0))])
            stretch = np.cumsum(change) - 1
            keep = (ids > 0) & (np.bincount(stretch)[stretch] >= phrase)
            last = np.append(stretch[1:] != stretch[:-1], True) & keep
            docs = np.asarray(keys, np.int64)[text]
            reps = keep.astype(np.int64) + last  # a separator follows the last word
            out = np.repeat(ids, reps)
            out[np.cumsum(reps)[last] - 1] = 0
            shard.append((out, np.repeat(docs, reps), np.repeat(at, reps)))
            size += len(out)
            if size >= INDEX_WORDS:
                yield _find(p, phrase, *(np.concatenate(x) for x in zip(*shard, strict=True)))
                shard, size = [], 0
        if size:
            yield _find(p, phrase, *(np.concatenate(x) for x in zip(*shard, strict=True)))

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys.append(k)
            texts.append(t)
            size += len(t)
            if size >= BLOCK:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def leaked_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", prompt: str = "prompt", phrase: int = PHRASE) -> DataFrame:
    """doc_id, item_id, first_word, end_word: stretches of a document's words that an item's text holds in the same
    order, at least ``phrase`` words long, touching ones merged. Words are runs of letters or digits in lower case.

    Keys of both tables are bigint. Rows with a null key or text give nothing, as do items shorter than a phrase;
    repeated rows repeat their spans; empty tables give an empty result. The items, held-out sets, are collected in
    passes of at most ``MAX_PHRASES`` words; the documents are read once a pass and never shuffled.
    """
    known = items.select(F.col(item).cast("bigint").alias("item"), F.col(prompt).alias("prompt")).where("item is not null and prompt is not null")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    schema = "doc_id bigint, item_id bigint, first_word int, end_word int"
    passes: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in known.toLocalIterator():
        size += len(r.prompt) // 2
        if size > MAX_PHRASES and passes[-1]:
            passes.append([])
            size = len(r.prompt) // 2
        passes[-1].append((r.item, r.prompt))
    out = None
    for part in passes:
        one = rows.mapInArrow(_searcher(part, phrase), schema)
        out = one if out is None else out.unionByName(one)
    return out


def leaked_items(spans: DataFrame) -> DataFrame:
    """Documents that each item leaked into, and the longest stretch."""
    return spans.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max(F.col("end_word") - F.col("first_word")).alias("longest"))
