"""Splitting oversized items at natural boundaries, by ranges of their texts.

A text is handled in ranges of fixed length with halos: it is parted once, and from then on no worker needs more of it
than a range. Each range reports its heading lines and word counts; these tables are stitched by prefix sums into
sections with exact token counts. Only sections over the limit are read again: cuts fall near multiples of a fixed
number of words, each at the best boundary of its stretch, so they are chosen independently of each other, and every
range emits by offset what it holds of each piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.scratch import Scratch

MAX_TOKENS, OVERLAP_TOKENS = 800, 100
#: Characters of a range, and of its halos, in which overlaps are looked for.
RANGE, HALO = 1 << 18, 1 << 12
_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[9, 10, 13, 32]] = True
_STOP = np.zeros(0x110000, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


def tokens_of(words: Column) -> Column:
    """floor(words * 4 / 3)."""
    return F.floor(words * 4 / 3).cast("int")


def words_within(tokens: int) -> int:
    """The most words whose token count is within the limit."""
    return (tokens * 3 + 2) // 4


_RANGE = "item string, range_no int, begin bigint, left int, own int, single boolean, part string"


def _parter(length: int, halo: int):
    """The ranges of long texts: each text is decoded once and sliced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RANGE.split(", ")]
        types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a in range(0, len(text), length):
                    left, own = min(a, halo), min(length, len(text) - a)
                    row = item, a // length, a, left, own, False, text[a - left : a + length + halo]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    return run


def _ranges(texts: DataFrame, length: int, halo: int) -> DataFrame:
    """One row a range of texts (item, text): its text with up to ``halo`` characters before (``left``) and after it.

    Short texts are a range as they are. Those of long ones are spread, so that one giant text occupies all workers.
    """
    n = F.char_length("text")
    whole = texts.where(n <= length).select(
        "item", F.lit(0).alias("range_no"), F.lit(0).cast("bigint").alias("begin"), F.lit(0).alias("left"), n.alias("own"), F.lit(True).alias("single"), F.col("text").alias("part")
    )
    long = texts.where(n > length).select("item", "text").mapInArrow(_parter(length, halo), _RANGE)
    return whole.unionByName(long.repartition("item", "range_no"))


def _join_texts(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4"), np.cumsum(lengths) - lengths


def _batched(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[list[tuple]]:
    rows, chars = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            chars += len(row[-1])
            if chars >= size:
                yield rows
                rows, chars = [], 0
    if rows:
        yield rows


def _line_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where lines start: after a line feed, and where a part starts (which the caller must know to be a line start)."""
    flag = np.zeros(len(codes), dtype=bool)
    flag[1:] = codes[:-1] == 10
    flag[starts[starts < len(codes)]] = True
    return np.flatnonzero(flag)


def _headings(codes: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of heading lines among line starts, and their levels."""
    line = line[codes[line] == 35]
    level = np.zeros(len(line), np.int64)
    padded = np.concatenate([codes, np.zeros(8, codes.dtype)])
    open_ = np.ones(len(line), dtype=bool)
    for k in range(7):
        c = padded[line + k]
        done = open_ & (c == 32) & (k > 0)
        level[done] = k
        open_ &= c == 35
    return line[level > 0], level[level > 0]


_SEGMENT = "item string, range_no int, seg int, start bigint, brk bigint, level int, title string, words bigint, head_words bigint, has_break boolean, in_heading boolean, rest string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each range: from its start to its first heading, then one a heading line.

    words: those that start after the segment's first line break (seg 0) or its heading line; head_words: those before
    it in segment 0, which belong to a heading if the range before ended inside one, as does ``rest``, its text.
    in_heading: a heading line that is open at the range's end; its title goes on in the ranges that follow.
    """
    for rows in _batched(batches):
        parts = [r[6] for r in rows]
        codes, base = _join_texts(parts)
        begin, left, own = (np.asarray([r[k] for r in rows], np.int64) for k in (2, 3, 4))
        lo, hi = base + left, base + left + own  # the range itself
        space = _SPACE[codes]
        word = ~space
        word[1:] &= space[:-1]
        fresh = base[begin == 0]
        word[fresh[fresh < len(codes)]] = ~space[fresh[fresh < len(codes)]]
        counts = np.concatenate([[0], np.cumsum(word)])
        # a part's first character starts a line if the text starts there; halos are wide enough elsewhere
        line = _line_starts(codes, fresh)
        line = line[(line >= lo[np.searchsorted(base, line, "right") - 1]) & (line < hi[np.searchsorted(base, line, "right") - 1])]
        head, level = _headings(codes, line)
        cut_up = np.asarray([r[5] for r in rows], bool)[np.searchsorted(base, head, "right") - 1]
        head, level = head[cut_up], level[cut_up]
        breaks = np.append(np.flatnonzero(codes == 10), len(codes))
        out: list[tuple] = []
        at = np.searchsorted(head, np.append(lo, len(codes)))
        for k, r in enumerate(rows):
            a, b = int(lo[k]), int(hi[k])
            heads = head[at[k] : at[k] + np.searchsorted(head[at[k] :], b)] if at[k] < len(head) else head[:0]
            end = int(heads[0]) if len(heads) else b
            first = min(int(breaks[np.searchsorted(breaks, a)]), end)
            out.append((r[0], r[1], 0, r[2], r[2] + first - a, 0, None, int(counts[end] - counts[first]), int(counts[first] - counts[a]), first < end or bool(len(heads)), False, parts[k][a - int(base[k]) : first - int(base[k])] if r[2] and r[5] else None))
            for j, h in enumerate(heads.tolist()):
                stop = int(breaks[np.searchsorted(breaks, h)])
                nxt = int(heads[j + 1]) if j + 1 < len(heads) else b
                lv = int(level[at[k] + j])
                title = parts[k][h - int(base[k]) : min(stop, b) - int(base[k])]
                inside = stop >= b and j + 1 == len(heads)
                out.append((r[0], r[1], j + 1, r[2] + h - a, None if inside else r[2] + min(stop, nxt) - a, lv, title, 0 if inside else int(counts[nxt] - counts[min(stop, nxt)]), 0, True, inside, None))
        cols = list(zip(*out, strict=True))
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in _SEGMENT.split(", ")])


def sections(items: DataFrame, length: int = RANGE, halo: int = HALO) -> DataFrame:
    """item, section_no, start, level, title, words, body, end: the parts of each text between heading lines.

    items: item (string; rows with one item hold one text), text, sectioned (false: the whole text is section 0). A
    heading line starts with one to six ``#`` and a space, wherever it stands. Section 0 is the text before the first
    one; sections without a word are kept. ``start``, ``body`` (the end of the heading line) and ``end`` are characters
    from 0; words leave the heading line out. ``end`` is null in an item's last section. Null texts have no section,
    empty ones an empty section 0. Repeated rows count once. An empty table gives an empty result.
    """
    given = items.where("item is not null and text is not null").select("item", "text", "sectioned")
    parts = None
    for flag in (True, False):
        one = _ranges(given.where("sectioned" if flag else "not sectioned"), length, halo).withColumn("sectioned", F.lit(flag))
        parts = one if parts is None else parts.unionByName(one)
    segs = parts.select("item", "range_no", "begin", "left", "own", "sectioned", "part").mapInArrow(_scan, _SEGMENT).repartition("item").dropDuplicates(["item", "range_no", "seg"])
    order = Window.partitionBy("item").orderBy("range_no", "seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("in_heading"), True).when(F.col("has_break"), False)
    segs = segs.select(
        "*",
        F.sum(F.when(F.col("seg") > 0, 1).otherwise(0)).over(order).alias("section_no"),
        F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(False)).alias("inside"),
    )
    inside = (F.col("seg") == 0) & F.col("inside")
    words = F.col("words") + F.when(inside, 0).otherwise(F.col("head_words"))
    opens = F.struct("range_no", "seg", "start", "brk", "level", "title")
    late = F.min(F.when(inside & F.col("has_break"), F.col("brk"))).alias("late")
    more = F.collect_list(F.when(inside, F.struct("range_no", "rest"))).alias("more")  # of a heading line through several ranges
    out = segs.groupBy("item", "section_no").agg(F.sum(words).alias("words"), F.min(opens).alias("o"), late, more)
    line = F.concat(F.col("o.title"), F.array_join(F.transform(F.array_sort("more"), lambda x: x["rest"]), ""))
    title = strip(F.expr("substring(line, o.level + 1)")).alias("title")
    out = out.withColumn("line", line)
    nxt = F.lead("o.start").over(Window.partitionBy("item").orderBy("section_no"))
    body = F.when(F.col("section_no") == 0, F.lit(0)).otherwise(F.coalesce("o.brk", "late", "o.start")).cast("bigint")
    return out.select("item", F.col("section_no").cast("int"), "o.start", "o.level", title, "words", body.alias("body"), nxt.alias("end"))


def section_paths(parts: DataFrame, sep: str = " > ") -> DataFrame:
    """``parts`` with section_path: titles of the enclosing headings, outermost first; empty before the first heading."""
    w = Window.partitionBy("item").orderBy("section_no")
    for k in range(1, 7):
        parts = parts.withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.struct("section_no", "title")), ignorenulls=True).over(w))
        parts = parts.withColumn(f"_l{k}", F.last(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("section_no")), ignorenulls=True).over(w))
    titles = [F.when(F.col(f"_h{k}.section_no") > F.coalesce(F.col(f"_l{k}"), F.lit(-1)), F.col(f"_h{k}.title")) for k in range(1, 7)]
    path = F.concat_ws(sep, *[F.nullif(t, F.lit("")) for t in titles])
    return parts.withColumn("section_path", path).drop(*[f"_{x}{k}" for k in range(1, 7) for x in "hl"])


_CUT = "item string, section_no int, k bigint, rank int, word bigint, at bigint, over_word bigint, over_at bigint"


def _word_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[codes]
    word = ~space
    word[1:] &= space[:-1]
    return space, word


def _by_range(ranges: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Each range beside the list (``x``) of what is wanted of it; wanted: item, from, to and others."""
    others = [c for c in wanted.columns if c != "item"]
    no = F.explode(F.sequence(F.floor(F.col("from") / length).cast("int"), F.floor(F.greatest("from", F.col("to") - 1) / length).cast("int"))).alias("range_no")
    lists = wanted.where("to > from").select("*", no).groupBy("item", "range_no").agg(F.collect_list(F.struct(*others)).alias("x"))
    return ranges.join(lists, ["item", "range_no"]).select("item", "range_no", "begin", "left", "own", "x", "part")


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each section that start in a range."""
    for batch in batches:
        out = []
        for item, no, begin, left, own, sections_, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = np.frombuffer(part.encode("utf-32-le"), dtype="<u4")
            space, word = _word_starts(codes)
            counts = np.concatenate([[0], np.cumsum(word)])
            for s in sections_:
                a, b = max(left, s["from"] - begin + left), min(left + own, s["to"] - begin + left)
                # a section starts a word of its own where it starts
                first = a == s["from"] - begin + left and not space[a] and not word[a]
                out.append((item, s["section_no"], no, int(counts[b] - counts[a]) + int(first)))
        if out:
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["item", "section_no", "range_no", "n"])


def _cutter(stride: int, slack: int, overlap: int):
    """Of every multiple of ``stride`` words the best boundary of the words before it, and where the piece after it starts."""

    def cut(codes: np.ndarray, word: np.ndarray, space: np.ndarray, begin: int, left: int, own: int, s: dict) -> list[tuple]:
        out = []
        first, last, before = s["from"] - begin + left, s["to"] - begin + left, s["before"]
        a, b = max(left, first), min(left + own, last)
        lo = max(0, first)  # words of the left halo serve as overlap
        at = np.flatnonzero(word[lo:b]) + lo
        if lo == first and not space[lo] and (not len(at) or at[0] != lo):
            at = np.concatenate([[lo], at])
        elif lo == 0 and begin > left and len(at) and at[0] == 0:
            at = at[1:]  # perhaps the rest of a word
        number = before + np.arange(len(at)) - np.searchsorted(at, a)
        feeds = np.concatenate([[0], np.cumsum(codes == 10)])
        gap_start = np.zeros(len(at), np.int64)
        ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
        slot = np.searchsorted(ends, at, "right") - 1
        gap_start[slot >= 0] = ends[slot[slot >= 0]]
        n = feeds[at] - feeds[gap_start]
        rank = np.where(n >= 2, 3, np.where(n == 1, 2, np.where(_STOP[codes[np.maximum(gap_start - 1, 0)]] & (gap_start > 0), 1, 0)))
        k = -(-number // stride)
        ok = np.flatnonzero((at >= a) & (number > 0) & (number > k * stride - slack))
        ok = ok[np.lexsort((ok, rank[ok], k[ok]))]
        for best in ok[np.append(k[ok][1:] != k[ok][:-1], True)] if len(ok) else ok:
            back = np.arange(np.searchsorted(number, number[best] - overlap), best)
            natural = back[rank[back] > 0]
            o = natural[0] if len(natural) else back[0] if len(back) else best
            shift = begin - left
            out.append((s["section_no"], int(k[best]), int(rank[best]), int(number[best]), int(at[best] + shift), int(number[o]), int(at[o] + shift)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4)
        for batch in batches:
            out: list[tuple] = []
            for item, _, begin, left, own, sections_, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.frombuffer(part.encode("utf-32-le"), dtype="<u4")
                space, word = _word_starts(codes)
                for s in sections_:
                    # what the section holds of the range, and the halo for the overlap
                    lo, hi = max(0, s["from"] - begin + left), min(len(codes), s["to"] - begin + left)
                    shift = max(0, lo - 1)
                    own_ = min(left + own, hi) - max(left, shift)
                    out += [(item, *c) for c in cut(codes[shift:hi], word[shift:hi], space[shift:hi], begin - left + max(left, shift), max(left, shift) - shift, own_, s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in _CUT.split(", ")])

    return run


def _emitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range holds of each piece."""
    names = ["item", "section_no", "piece_no", "start", "end", "token_count", "range_no", "content"]
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    for batch in batches:
        for item, no, begin, left, own, pieces, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shift = begin - left
            rows = [(item, p["section_no"], p["piece_no"], p["from"], p["to"], p["token_count"], no, part[max(begin, p["from"]) - shift : min(begin + own, p["to"]) - shift]) for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def split_sections(items: DataFrame, large: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, length: int = RANGE, halo: int = HALO) -> DataFrame:
    """item, section_no, piece_no, start, end, content, token_count: pieces of the sections ``large``, all within the limit.

    large: item, section_no, body (first character after the heading line), end (null: the text's end), words.
    A piece after the first starts up to ``overlap_tokens`` before the cut, at a natural boundary where there is one.
    Boundaries are, best first: a blank line, a line, the end of a sentence, a word.
    """
    limit, overlap = words_within(max_tokens), words_within(overlap_tokens)
    stride = (limit - overlap) * 4 // 5
    slack = limit - overlap - stride
    if stride < 1:
        raise ValueError("the overlap must be smaller than the limit")
    scratch = Scratch(items.sparkSession, "pieces")
    large = scratch.cut(large)
    texts = items.select("item", "text").join(large.select("item").distinct(), "item", "left_semi").dropDuplicates(["item"])
    ranges = scratch.cut(_ranges(texts, length, halo))
    chars = ranges.groupBy("item").agg(F.max(F.col("begin") + F.col("own")).alias("chars"))
    parts = large.join(chars, "item").select("item", "section_no", F.col("body").alias("from"), F.least(F.coalesce("end", "chars"), "chars").alias("to"), "words")
    parts = scratch.cut(parts)
    # words before each range, counted only where there are several
    section = ["item", "section_no", "from", "to"]
    counted = _by_range(ranges.where("not single"), parts.select(section), length).mapInArrow(_counter, "item string, section_no int, range_no int, n bigint")
    w = Window.partitionBy("item", "section_no").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("item", "section_no", "range_no", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inside = before.join(parts.select(section), ["item", "section_no"])
    inside = inside.select("item", "section_no", F.greatest("from", F.col("range_no").cast("bigint") * length).alias("a"), "from", "to", "before", "range_no")
    lone = parts.join(ranges.where("single").select("item"), "item", "left_semi").select("item", "section_no", F.col("from").alias("a"), "from", "to", F.lit(0).cast("bigint").alias("before"), F.lit(0).alias("range_no"))
    lists = inside.unionByName(lone).groupBy("item", "range_no").agg(F.collect_list(F.struct("section_no", "from", "to", "before")).alias("x"))
    cuts = ranges.join(lists, ["item", "range_no"]).select("item", "range_no", "begin", "left", "own", "x", "part").mapInArrow(_cutter(stride, slack, overlap), _CUT)
    best = scratch.cut(cuts.groupBy("item", "section_no", "k").agg(F.max(F.struct("rank", "word", "at", "over_word", "over_at")).alias("c")))
    w = Window.partitionBy("item", "section_no").orderBy("k")
    planned = (
        best.join(parts.select("item", "section_no", "words"), ["item", "section_no"]).where(F.expr(f"k * {stride} < words"))
        .select("item", "section_no", "k", F.col("c.over_at").alias("start"), F.col("c.over_word").alias("w0"), F.lead("c.at").over(w).alias("end"), F.lead("c.word").over(w).alias("w1"))
    )
    firsts = best.where("k = 1").select("item", "section_no", F.lit(0).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("w0"), F.col("c.at").alias("end"), F.col("c.word").alias("w1"))
    pieces = planned.unionByName(firsts).join(parts, ["item", "section_no"]).select(
        "item", "section_no", F.col("k").cast("int").alias("piece_no"), F.coalesce("start", "from").alias("from"), F.coalesce("end", "to").alias("to"),
        tokens_of(F.coalesce("w1", "words") - F.col("w0")).alias("token_count"),
    )
    kind = "item string, section_no int, piece_no int, start bigint, end bigint, token_count int, range_no int, content string"
    held = _by_range(ranges, pieces, length).mapInArrow(_emitter, kind)
    crosses = f"start div {length} <> (end - 1) div {length}"
    at = ["item", "section_no", "piece_no", "start", "end", "token_count"]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "content"))), lambda x: x["content"]), "").alias("content")
    out = held.where(f"not ({crosses})").drop("range_no").unionByName(held.where(crosses).groupBy(at).agg(joined))
    return out.select("item", "section_no", "piece_no", "start", "end", "content", "token_count")


def items_of(rows: DataFrame, table: str, key: str, text: str, sectioned: bool, path: str | None = None) -> DataFrame:
    """item_table, item_key, item, text, sectioned, path: one item for each different text of a key; null keys or texts have none."""
    item = F.md5(F.concat_ws("\x00", F.lit(table), F.col(key).cast("string"), F.col(text)))
    return rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.lit(table).alias("item_table"), F.col(key).cast("string").alias("item_key"), item.alias("item"), F.col(text).alias("text"), F.lit(sectioned).alias("sectioned"),
        (F.col(path) if path else F.lit(None)).cast("string").alias("path"),
    )


def oversized(items: DataFrame, max_tokens: int = MAX_TOKENS, length: int = RANGE, halo: int = HALO) -> DataFrame:
    """The sections of ``items`` with more than ``max_tokens``; texts too short to hold as many words aren't scanned."""
    least = 2 * words_within(max_tokens) + 1
    return sections(items.where(F.char_length("text") >= least), length, halo).where(F.col("words") > words_within(max_tokens))
