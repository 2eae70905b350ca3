"""Long exact spans shared between records, by content-defined chunks cut with a gear rolling hash.

Every window of ``span`` characters belongs to one chunk: the one of the window's cut point, which is the position
with the least gear hash inside it. A chunk is the text of all neighbouring windows with one cut point, so chunks
have any length from ``span`` on, overlap by ``span - 1`` characters, follow the content and survive insertions.
Equal chunks (by digest) of different records are shared as a whole. Chunks with equal cut points but other
surroundings, which are the ends of shared spans, are compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.orphans import BITS_PER_KEY, MAX_FILTER_BITS, bloom_words, filter_bits, might_contain
from graphloom.scratch import Scratch

SPAN = 300
#: Characters that a gear hash of 64 bits sees, as each one is shifted out after 64 steps.
GRAM = 64
#: Characters handled at once, and the length of the slices of giant texts.
BLOCK = 1 << 20
#: Distance of the positions of a key's texts, more than any text is long.
BASE = 1 << 32
#: Chunks of one cut point that a single task compares; larger groups are compared by distributed aggregation.
HOT = 5_000
_POS = np.uint64(24)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")


class _Hashes:
    """Hashes of any substring of a block, independent of where it stands: sums of character values times B**-i."""

    _B = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    _up = _down = np.zeros(0, dtype=_U)

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes) + 1
        if len(_Hashes._up) < n:
            m = max(n, BLOCK + BLOCK // 4)
            _Hashes._up, _Hashes._down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(m, b, _U)])) for b in (pow(self._B, -1, 1 << 64), self._B))
        self.values = _mix(codes.astype(_U) + _U(0x9E3779B97F4A7C15))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.values * self._down[: n - 1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self._up[start] + (end - start).astype(_U))


def _gear(values: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + value[i], each position seeing the last 64 characters."""
    h, k = values.copy(), 1
    while k < GRAM:
        h[k:] = h[k:] + (h[:-k] << _U(k))
        k *= 2
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    m, k = keys, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    rest = width - k
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def chunk_texts(texts: list[str], span: int) -> tuple[np.ndarray, ...]:
    """Of a block of texts: text number, first window, windows, cut-point hash, digest, and keys of its two sides.

    A side key covers the cut point's gram and the ``(span - GRAM) // 2`` characters before or after it: any window
    with this cut point holds one of the two wholly. Where a text ends before, the key is 0.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = _codes(texts)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = len(codes)
    if n < span:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    hashes = _Hashes(codes)
    place = _U((1 << 24) - 1) - np.arange(n, dtype=_U)  # the last of equal hashes is cut at
    keys = (_mix(_gear(hashes.values)) & ~_U((1 << 24) - 1)) | place
    best = _least(keys[GRAM - 1 :], span - GRAM + 1)
    room = np.maximum(lengths - span + 1, 0)
    window = np.repeat(starts - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    cut = (_U((1 << 24) - 1) - (best[window] & _U((1 << 24) - 1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]])) if len(cut) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(cut)]]))
    begin, at = window[first], cut[first]
    text = np.searchsorted(ends, begin, side="right")
    side = (span - GRAM) // 2
    gram = at - GRAM + 1
    left, right = gram - side, at + 1 + side
    has_left, has_right = left >= starts[text], right <= ends[text]
    k_left = np.where(has_left, hashes.of(np.maximum(left, 0), at + 1), _U(0))
    k_right = np.where(has_right, hashes.of(gram, np.minimum(right, n)) + _U(1), _U(0))
    return text, begin - starts[text], count, hashes.of(gram, at + 1), hashes.of(begin, begin + count + span - 1), k_left, k_right


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[int]]]:
    """Ids, texts and offsets of about BLOCK characters at a time; longer texts in slices that overlap by a window."""
    ids, texts, offsets, size = [], [], [], 0
    for batch in batches:
        for key, base, text, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for a in range(0, max(1, len(text) - span + 1), BLOCK):
                part = text if len(text) <= BLOCK else text[a : a + BLOCK + span - 1]
                ids.append(key)
                texts.append(part)
                offsets.append(base + a)
                size += len(part)
                if size >= BLOCK // 2:
                    yield ids, texts, offsets
                    ids, texts, offsets, size = [], [], [], 0
                if part is text:
                    break
    if ids:
        yield ids, texts, offsets


def _chunker(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, offsets in _blocks(batches):
            text, first, count, cut, digest, left, right = chunk_texts(texts, span)
            if len(text):
                rows = np.asarray(ids, dtype=np.int64)[text], first + np.asarray(offsets, dtype=np.int64)[text], count
                whole = [np.ascontiguousarray(x).view(np.int64) for x in (cut, digest, left, right)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), *map(pa.array, whole)],
                    names=["doc", "first", "n", "cut", "digest", "left", "right"],
                )

    return run


_CHUNK = "doc bigint, first bigint, n int, cut bigint, digest bigint, left bigint, right bigint"


def _windows(texts: list[str], counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk number and hash of every window."""
    lengths = counts + span - 1
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return owner, _Hashes(_codes(texts)).of(at, at + span)


def _runs(owner: np.ndarray, flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last window of each run of flagged windows."""
    on = np.flatnonzero(flags)
    new = np.concatenate([[True], (np.diff(on) != 1) | (owner[on[1:]] != owner[on[:-1]])]) if len(on) else np.zeros(0, bool)
    a = on[new]
    b = on[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(on) - 1]])] if len(on) else a
    base = np.cumsum(counts) - counts
    return owner[a], a - base[owner[a]], b - base[owner[a]]


def _comparer(span: int):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        cut, digest, lo, hi, n, text = (list(x) for x in zip(*rows, strict=True))
        counts, lo, hi = np.asarray(n, np.int64), np.asarray(lo, np.int64), np.asarray(hi, np.int64)
        owner, h = _windows(text, counts, span)
        order = np.argsort(h, kind="stable")
        seg = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        seg_of = np.zeros(len(h), np.int64)
        seg_of[order] = np.repeat(np.arange(len(seg)), np.diff(np.concatenate([seg, [len(h)]])))
        low, high = np.minimum.reduceat(lo[owner][order], seg), np.maximum.reduceat(hi[owner][order], seg)
        who, a, b = _runs(owner, low[seg_of] != high[seg_of], counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(cut, np.int64)[who]), pa.array(np.asarray(digest, np.int64)[who]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
            names=["cut", "digest", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK and row[0] != last:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
                last = row[0]
        if rows:
            yield flush(rows)

    return run


def _window_rows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, digest, lo, hi, n, text = (c.to_pylist() for c in batch.columns)
            if text:
                counts = np.asarray(n, np.int64)
                owner, h = _windows(text, counts, span)
                at = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
                cols = [np.asarray(x, np.int64)[owner] for x in (cut, digest, lo, hi)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["cut", "digest", "lo", "hi", "at", "h"])

    return run


def _numbered(given: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc, base, text of ``given``, and doc, base, d, n of all: base is 0, or, where a key has several texts, BASE times the text's number."""
    own = given.select("doc", F.md5("text").alias("d"), F.char_length("text").alias("n"))
    several = scratch.cut(own.groupBy("doc").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("doc"))
    if not several.limit(1).count():
        zero = F.lit(0).cast("bigint").alias("base")
        return given.select("doc", zero, "text"), own.select("doc", zero, "d", "n")
    number = F.row_number().over(Window.partitionBy("doc").orderBy("d")) - 1
    bases = scratch.cut(own.join(several, "doc", "left_semi").select("doc", "d").distinct().select("doc", "d", (number.cast("bigint") * BASE).alias("base")))
    both = []
    for rows in (given.withColumn("d", F.md5("text")), own):
        one = rows.join(several, "doc", "left_anti").withColumn("base", F.lit(0).cast("bigint"))
        both.append(one.unionByName(rows.join(bases, ["doc", "d"]).select(one.columns)))
    return both[0].select("doc", "base", "text"), both[1].select("doc", "base", "d", "n")


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, hot: int = HOT, most: int = MAX_FILTER_BITS) -> DataFrame:
    """doc, start, end (characters from 0, end excluded): all text that stands in spans of ``span`` characters or more
    which another key's text holds too; pieces of one text may overlap. Exact copies of a text have one row each, over
    all of it. Keys are bigint; rows with a null key or text, and texts under ``span`` characters, have no row. A key
    may have several texts, which share nothing with each other; the characters of its second, in order of their md5,
    are counted from BASE, and so on. A row repeated counts once. An empty table gives an empty result.

    Filters of at most ``most`` bits are broadcast to move only what may be shared; where they would take more, the same
    is found by joins.
    """
    if span < 2 * GRAM:
        raise ValueError(f"span must be at least {2 * GRAM}")
    scratch = Scratch(docs.sparkSession, "spans")
    given = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(f"doc is not null and char_length(text) >= {span}")
    given, own = _numbered(given, scratch)
    # of exact copies two are searched, those of the least and the greatest key; only keys and digests are shuffled
    copies = own.groupBy("d").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    copied = scratch.cut(own.join(copies.where("first <> last"), "d").select("doc", "base", "n", F.expr("doc = first or doc = last").alias("searched")).distinct())
    kept = given.join(copied.where("not searched"), ["doc", "base"], "left_anti")
    width = F.lit(span).alias("span")
    chunks = scratch.cut(kept.select("doc", "base", "text", width).mapInArrow(_chunker(span), _CHUNK))
    keys = chunks.select("doc", F.explode(F.array("left", "right")).alias("key")).where("key <> 0")
    twice, (n_twice, *_) = scratch.cut_state(keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("key"), "key")
    cols = ["doc", "first", "n", "cut", "digest"]
    if BITS_PER_KEY * n_twice <= most:
        # drops the rest without moving it; what passes by chance is compared like all others
        bits = filter_bits(n_twice)
        bloom = scratch.cut(bloom_words(twice, bits))
        near = chunks.where(might_contain(F.col("left"), bloom.scalar(), bits) | might_contain(F.col("right"), bloom.scalar(), bits)).select(cols)
    else:
        sides = chunks.select(*cols, F.explode(F.array("left", "right")).alias("key")).where("key <> 0")
        near = sides.join(twice, "key", "left_semi").select(cols).distinct()
    near = scratch.cut(near)
    scratch.drop(chunks)
    kinds = near.groupBy("cut", "digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "first")).alias("one"), F.max("n").alias("n"))
    kinds = scratch.cut(kinds.select("cut", "digest", "lo", "hi", F.col("one.doc").alias("doc"), F.col("one.first").alias("first"), "n"))
    # cut points with one kind of chunk are settled by its digest
    per_cut = kinds.groupBy("cut").agg(F.count("*").alias("kinds"), F.min("lo").alias("l"), F.max("hi").alias("h"))
    unsettled = per_cut.where("kinds > 1 and l <> h").join(kinds.where("lo = hi").select("cut").distinct(), "cut", "left_semi").select("cut", "kinds")
    compare, (n_compare, *_) = scratch.cut_state(kinds.join(unsettled, "cut").withColumn("base", F.expr(f"first - first % {BASE}")), "digest")
    texts = kept
    if BITS_PER_KEY * n_compare <= most:
        doc_bits = filter_bits(n_compare)
        doc_bloom = scratch.cut(bloom_words(compare.select(F.col("doc").alias("key")), doc_bits))
        texts = kept.where(might_contain(F.col("doc"), doc_bloom.scalar(), doc_bits))
    settled = _settle(compare, texts, span, hot, scratch)
    whole = kinds.where("lo <> hi").selectExpr("cut", "digest", "0 as a", "n - 1 as b")
    found = near.join(whole.unionByName(settled), ["cut", "digest"]).selectExpr("doc", "first - first % {0} as base".format(BASE), "first + a as start", f"first + b + {span} as end")
    found = found.join(copied.select("doc", "base"), ["doc", "base"], "left_anti").select("doc", "start", "end")
    return found.unionByName(copied.selectExpr("doc", "base as start", "base + n as end"))


def _settle(compare: DataFrame, texts: DataFrame, span: int, hot: int, scratch: Scratch) -> DataFrame:
    """cut, digest, a, b: the runs of windows that chunks of one cut point share with another key's.

    Each text meets the list of its chunks in one row, and is read once for all of them.
    """
    wanted = compare.groupBy("doc", "base").agg(F.collect_list(F.struct("cut", "digest", "lo", "hi", "first", "n", "kinds")).alias("x"))
    once = texts.dropDuplicates(["doc", "base"])  # by the join's keys, so nothing is moved twice
    pieces = wanted.join(once, ["doc", "base"]).select("base", "text", "x").mapInArrow(_piece_cutter(span), _PIECE)
    few = pieces.where(F.col("kinds") <= hot).drop("kinds").repartition("cut").sortWithinPartitions("cut")
    settled = few.mapInArrow(_comparer(span), "cut bigint, digest bigint, a int, b int")
    if compare.where(F.col("kinds") > hot).limit(1).count():
        rows = scratch.cut(pieces.where(F.col("kinds") > hot).drop("kinds").mapInArrow(_window_rows(span), "cut bigint, digest bigint, lo bigint, hi bigint, at int, h bigint"))
        met = rows.groupBy("h").agg(F.min("lo").alias("l"), F.max("hi").alias("u")).where("l <> u").select("h")
        settled = settled.unionByName(rows.join(met, "h", "left_semi").selectExpr("cut", "digest", "at as a", "at as b"))
    return settled


_PIECE = "cut bigint, digest bigint, lo bigint, hi bigint, n int, text string, kinds bigint"


def _piece_cutter(span: int):
    """The texts of the listed chunks, each row's text decoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECE.split(", ")]
        types = (*[pa.int64()] * 4, pa.int32(), pa.string(), pa.int64())
        for batch in batches:
            for base, text, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in range(0, len(chunks), 2000):
                    rows = [(c["cut"], c["digest"], c["lo"], c["hi"], c["n"], text[c["first"] - base : c["first"] - base + c["n"] + span - 1], c["kinds"]) for c in chunks[s : s + 2000]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def shared_lengths(spans: DataFrame) -> DataFrame:
    """doc_id, shared_chars (bigint): characters of each text inside its spans, overlaps counted once."""
    w = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0))))
    return spans.withColumn("new", new).groupBy(F.col("doc").alias("doc_id")).agg(F.sum("new").cast("bigint").alias("shared_chars"))
