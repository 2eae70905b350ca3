"""Variant spellings of names typed by people, linked by metric-space partitioning under the edit distance.

Names are first brought to a plain form by what the corpus itself shows, without word lists: words in which a type's
names end again and again (kind words) and words whose loss leaves another given name (noise) are left out, with their
slips and short forms; a rare word that stands where a frequent one stands is read as it (an alias); numbers, letters,
years and compass words are set apart. What remains are typing errors: plain forms within a small Levenshtein
distance. Pivots chosen far from each other divide the forms into cells; a form that holds a word which isn't
established in the corpus is searched for in the cell of its nearest pivot, and by the triangle inequality every form
within the radius of it stands there too, if each form is also placed in all cells whose pivot is at most twice the
radius farther away than its nearest. Crowded cells are divided again by pivots of their own, and what stays crowded
is compared in blocks.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import ChainMap
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import connected_components
from graphloom.scratch import Scratch

RADIUS = 2
#: A word is established if this share of the names holds it, so there are at most a few ten thousand of them.
SHARE, AT_LEAST = 2e-4, 3
#: A word is a slip, however often it occurs, if a word this many times as frequent lies near it.
MUCH = 10
#: A kind word stands in this share of a type's names, at the end of at least half of them.
KIND_SHARE = 0.1
#: A word is noise if so many of its names are given without it as well.
NOISE = 0.4
#: An alias occurs in some contexts at least; of these it must share so many with its meaning, which is so many times as
#: frequent. Those in this share of the names (at most some hundred thousand) go through the driver, the others by joins.
CONTEXTS, AGREE, TIMES, ALIAS_SHARE = 3, 0.3, 3, 2e-5
#: Pairs of probes and targets from which a cell is divided again, levels of division, and the sides of a block.
CROWDED, LEVELS, SIDE = 1 << 25, 3, 1 << 13
#: Forms that pivots of a cell are chosen from, and pivots of one cell.
SAMPLE, PIVOTS = 2048, 256
#: Rows that a task works on at once, rows of a cell that go to one task, and words whose readings a task remembers.
AT_ONCE, SHARED, REMEMBERED = 2048, 1 << 16, 1 << 16

# Words that tell things apart as a number does.
COMPASS = frozenset("north south east west".split())
PERSON_TYPES = ("party", "person")


def words_of(name: str) -> list[str]:
    """Lower-case words without accents and remarks in brackets; run-together words are parted at capitals."""
    s = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    s = re.sub(r"\([^)]*\)", " ", s)
    s = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\.)|(?<=\b[A-Za-z]\.[A-Za-z])\.", r"\1", s)  # A.P.I.
    s = re.sub(r"(?<=\w)['’/.](?=\w)", "", s)
    s = re.sub(r"(?<=[a-z]{2})(?=[A-Z])", " ", s)
    return re.findall(r"[^\W_]+", s.lower())


def abbreviates(short: str, long: str) -> bool:
    """Whether ``short`` has the first letter and some others of ``long``, in order, and leaves out two or more."""
    if len(short) < 2 or len(short) + 2 > len(long) or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def is_apart(word: str) -> bool:
    """Numbers, single letters and compass words tell things apart."""
    return word.isdigit() or len(word) == 1 or word in COMPASS


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance of two strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Forms:
    """Strings as arrays: letters, lengths, the last bit, a table of bits by letter, and a signature of two bits a letter."""

    #: Letters for which there may be a table; more are compared one by one.
    LETTERS = 512

    def __init__(self, texts: list[str]) -> None:
        self.texts, n = texts, len(texts)
        self.length = np.fromiter(map(len, texts), np.int64, n)
        width = int(min(64, self.length.max(initial=1))) or 1
        flat = np.frombuffer("".join(t[:64] for t in texts).encode("utf-32-le"), "<u4")
        short = np.minimum(self.length, width)
        row = np.repeat(np.arange(n), short)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(short) - short, short)
        self.codes = np.zeros((n, width), np.uint32)
        self.codes[row, at] = flat
        self.last = np.uint64(1) << np.maximum(short - 1, 0).astype(np.uint64)
        self.letters, place = np.unique(flat, return_inverse=True)
        self.table = None
        if len(self.letters) <= self.LETTERS:
            self.table = np.zeros((len(self.letters) + 1, n), np.uint64)
            np.bitwise_or.at(self.table, (place, row), np.uint64(1) << at.astype(np.uint64))
        # one edit changes the numbers of at most two letters by one, and so at most two bits
        count = np.bincount(row * 32 + flat % 32, minlength=n * 32).reshape(n, 32)
        bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
        self.signature = ((count >= 1) * bit).sum(1, dtype=np.uint64) | (((count >= 2) * bit).sum(1, dtype=np.uint64) << np.uint64(32))

    def numbers(self, other: Forms) -> np.ndarray | None:
        """The rows of the table for the letters of ``other``."""
        if self.table is None or not len(self.letters):
            return None
        k = np.minimum(np.searchsorted(self.letters, other.codes), len(self.letters) - 1)
        return np.where(self.letters[k] == other.codes, k, len(self.letters))

    def bits(self, letters: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where each row's string has the letter that stands beside it."""
        place = np.arange(self.codes.shape[1], dtype=np.uint64)
        same = (self.codes[rows] == letters[:, None]) & (place < self.length[rows, None])
        return (same.astype(np.uint64) << place).sum(1, dtype=np.uint64)


def distances(a: Forms, i: np.ndarray, b: Forms, j: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the pairs a[i], b[j], all at once by bit vectors; exact for any length."""
    out = np.empty(len(i), np.int64)
    numbers = b.numbers(a)
    for s in range(0, len(i), 1 << 14):
        part = slice(s, s + (1 << 14))
        out[part] = _some_distances(a, i[part], b, j[part], numbers)
    for k in np.flatnonzero((a.length[i] > 64) | (b.length[j] > 64)):
        out[k] = edit_distance(a.texts[i[k]], b.texts[j[k]])
    return out


def _some_distances(a: Forms, i: np.ndarray, b: Forms, j: np.ndarray, numbers: np.ndarray | None) -> np.ndarray:
    one, order = np.uint64(1), np.argsort(-a.length[i], kind="stable")  # longest first: the others drop out on the way
    i, j = i[order], j[order]
    length, last = a.length[i], b.last[j]
    up, down, score = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64), b.length[j].copy()
    n = len(i)
    for k in range(int(min(a.codes.shape[1], length.max(initial=0)))):
        n = int(np.searchsorted(-length[:n], -k))  # those longer than k
        u, d, ends = up[:n], down[:n], last[:n]
        eq = b.table[numbers[i[:n], k], j[:n]] if numbers is not None else b.bits(a.codes[i[:n], k], j[:n])
        xv = eq | d
        xh = (((eq & u) + u) ^ u) | eq
        ph, mh = d | ~(xh | u), u & xh
        score[:n] += ((ph & ends) != 0).astype(np.int64) - ((mh & ends) != 0)
        ph = (ph << one) | one
        up[:n], down[:n] = (mh << one) | ~(xv | ph), ph & xv
    out = np.empty(len(i), np.int64)
    out[order] = np.where(b.length[j] == 0, length, score)
    return out


class Vocabulary:
    """What the corpus says of words. firm: established words that are no slips; known: all established ones."""

    def __init__(
        self, counts: dict[str, int], kinds: dict[str, tuple[str, ...]] | None = None, noise: frozenset[str] = frozenset(), aliases: dict[str, tuple[str, ...]] | None = None,
        nicknames: dict[str, tuple[str, ...]] | None = None, radius: int = RADIUS,
    ) -> None:
        self.kinds, self.noise = kinds or {}, noise
        self.aliases = {**(aliases or {}), **(nicknames or {})}
        of_kind = frozenset(w for k in self.kinds.values() for w in k)
        self.known = frozenset(counts)
        self.firm = self.known - frequent_slips(counts, of_kind, radius)
        self._by_letter: dict[str, list[str]] = {}
        for w in self.firm:
            self._by_letter.setdefault(w[0], []).append(w)
        self._long: dict[str, tuple[str, ...]] = {}
        self._kind: dict[tuple[str, str], int] = {}

    def long_forms(self, word: str) -> tuple[str, ...]:
        """Established words that a word which isn't may abbreviate."""
        if word in self.known:
            return ()
        if word not in self._long:
            if len(self._long) >= REMEMBERED:
                self._long.clear()
            self._long[word] = tuple(sorted(w for w in self._by_letter.get(word[0], ()) if abbreviates(word, w)))
        return self._long[word]

    def kind_distance(self, word: str, type_: str) -> int:
        """How far a word is from a kind word of the type: 0 one itself, 1 short for one, from 2 on a slip, 9 none."""
        at = word, type_
        if at not in self._kind:
            if len(self._kind) >= REMEMBERED:
                self._kind.clear()
            kinds = self.kinds.get(type_, ())
            self._kind[at] = 0 if word in kinds else 1 if any(abbreviates(word, k) for k in kinds) else min((2 + d for k in kinds if (d := _slip(word, k))), default=9)
        return self._kind[at]


def _slip(word: str, of: str) -> int:
    """Edit distance of a word that may be a slip of ``of``; 0 if it's none."""
    if abs(len(of) - len(word)) > 2 or len(of) < 3 or len(word) < 2 or word == of:
        return 0
    d = edit_distance(word, of)
    return d if d <= (2 if len(of) > 4 or sorted(word) == sorted(of) else 1) else 0


def frequent_slips(counts: dict[str, int], of_kind: frozenset[str] = frozenset(), radius: int = RADIUS) -> set[str]:
    """Words near one that is MUCH as frequent, so that it's a share of that word's occurrences which counts, at any size.

    Near: one edit, two letters changed round, or ``radius`` edits for long words and from kind words of five letters or
    more. Kind words and words of up to three letters are no slips. Compared are the at most few thousand words
    frequent enough to have slips among ``counts``.
    """
    least = min(counts.values(), default=0) * MUCH
    often, rare = Forms(sorted(w for w, n in counts.items() if n >= least and len(w) > 2)), Forms(sorted(w for w in counts if w not in of_kind and len(w) > 3 and not w.isdigit()))
    found = set()
    for i, j, d in near_pairs(rare, often, np.full(len(rare.texts), radius)):
        for w, v, k in zip((rare.texts[x] for x in i), (often.texts[x] for x in j), d.tolist(), strict=True):
            wide = len(w) > 8 or (v in of_kind and len(v) > 4) or sorted(v) == sorted(w)
            if k and counts[v] >= MUCH * counts[w] and (wide or k == 1):
                found.add(w)
    return found


def near_pairs(probes: Forms, targets: Forms, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a probe and a target within the probe's distance ``most``, in tiles: lengths and signatures rule most out."""
    order = np.argsort(targets.length, kind="stable")
    lengths, signature = targets.length[order], targets.signature[order]
    by = np.argsort(probes.length, kind="stable")
    for s in range(0, len(by), 256):
        p = by[s : s + 256]
        widest = int(most[p].max())
        a, b = np.searchsorted(lengths, [probes.length[p[0]] - widest, probes.length[p[-1]] + widest + 1])
        for t in range(int(a), int(b), 1 << 13):
            u = min(t + (1 << 13), int(b))
            fits = np.bitwise_count(probes.signature[p, None] ^ signature[t:u]) <= 2 * most[p, None]
            fits &= np.abs(probes.length[p, None] - lengths[t:u]) <= most[p, None]
            i, j = np.nonzero(fits)
            i, j = p[i], order[j + t]
            d = distances(probes, i, targets, j)
            good = d <= most[i]
            if good.any():
                yield i[good], j[good], d[good]


_TOLD = "type string, rest string, w string"


def _contexts(kinds: dict[str, tuple[str, ...]]):
    """Of each name the words but its kinds in order of the alphabet (w null), and each word with the others beside it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, words in zip(b.type, b.words, strict=True):
                of = kinds.get(t, ())
                keep = sorted(w for w in words if w not in of) or sorted(words)
                out.append((t, " ".join(keep), None))
                out.extend((t, " ".join(keep[:i] + keep[i + 1 :]), w) for i, w in enumerate(keep) if len(keep) > 1 and not is_apart(w))
            yield pd.DataFrame(out, columns=["type", "rest", "w"])

    return run


def learn(words: DataFrame, scratch: Scratch, nicknames: dict[str, tuple[str, ...]] | None = None, radius: int = RADIUS) -> tuple[Vocabulary, DataFrame | None]:
    """Vocabulary of names (type, words), and the aliases too rare for it (w, meanings), if there may be any.

    What reaches the driver is bounded by shares of the names, whatever their number; rarer aliases don't pass it.
    """
    total = words.count()
    enough = max(AT_LEAST, SHARE * total)
    each = words.select("type", F.explode(F.array_distinct("words")).alias("w"))
    counts = {r.w: r["count"] for r in each.groupBy("w").count().where(F.col("count") >= enough).collect()}
    sizes = words.groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    last = words.select("type", F.explode(F.array_distinct("words")).alias("w"), F.element_at("words", -1).alias("end"))
    kind = last.groupBy("type", "w").agg(F.count("*").alias("k"), F.count_if(F.col("w") == F.col("end")).alias("e")).join(sizes, "type")
    kinds: dict[str, tuple[str, ...]] = {}
    for r in kind.where((F.col("k") >= F.greatest(F.lit(AT_LEAST), KIND_SHARE * F.col("n"))) & (2 * F.col("e") >= F.col("k"))).orderBy("type", "w").collect():
        if r.type not in PERSON_TYPES and not is_apart(r.w):
            kinds[r.type] = (*kinds.get(r.type, ()), r.w)
    told = scratch.cut(words.mapInPandas(_contexts(kinds), _TOLD).groupBy("type", "rest", "w").agg(F.count("*").alias("n")))
    beside = told.where("w is not null")
    whole = told.where("w is null").select("type", "rest").withColumn("given", F.lit(1))
    lost = beside.join(whole, ["type", "rest"], "left").groupBy("w").agg(F.count("*").alias("n"), F.count("given").alias("without"))
    noise = frozenset(r.w for r in lost.where((F.col("n") >= enough) & (F.col("without") >= NOISE * F.col("n"))).collect())
    # how much of a rare word's contexts holds a frequent one; in wide contexts each word weighs less
    often = scratch.cut(beside.groupBy("w").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= CONTEXTS))
    narrow = beside.groupBy("type", "rest").agg(F.count("*").alias("k")).where("k >= 2")
    seen = scratch.cut(beside.join(narrow, ["type", "rest"]).join(often, "w").select("type", "rest", "w", "k", "contexts"))
    # two words weigh together at most what either weighs in all its contexts, so words of less than 1 have no part in a pair
    able = seen.groupBy("w").agg(F.sum(1 / (F.col("k") - 1)).alias("all")).where(F.col("all") >= 1 - 1e-9).select("w")
    seen = scratch.cut(seen.join(able, "w", "left_semi"))
    both = seen.join(seen.select("type", "rest", F.col("w").alias("of"), F.col("contexts").alias("others")), ["type", "rest"]).where("others >= contexts and w <> of")
    both = both.groupBy("w", "of", "contexts", "others").agg(F.count("*").alias("n"), F.sum(1 / (F.col("k") - 1)).alias("weight"))
    both = both.where((F.col("n") >= CONTEXTS) & (F.col("weight") >= 1) & (F.col("n") >= AGREE * F.col("contexts")))
    # a short form may be nearly as frequent as the word
    both = both.where(f"others >= {TIMES} * contexts or (left(w, 1) = left(of, 1) and length(w) + 2 <= length(of))")
    best = both.groupBy("w").agg(F.max("n").alias("best"))
    told = both.join(best, "w").where("3 * n >= 2 * best").select("w", "of", "contexts", "others")
    share = ALIAS_SHARE * total
    if share > CONTEXTS:
        told = scratch.cut(told)
    meanings: dict[str, list[str]] = {}
    for r in told.where(F.col("contexts") >= share).collect():
        if r.w not in noise and r.of not in noise and (r.others >= TIMES * r.contexts or abbreviates(r.w, r.of)):
            meanings.setdefault(r.w, []).append(r.of)
    # a meaning that is itself an alias means what that one means
    aliases = {w: tuple(sorted({x for m in ms for x in (meanings.get(m) or [m])} - {w})) for w, ms in meanings.items()}
    v = Vocabulary(counts, kinds, noise, {w: ms for w, ms in aliases.items() if ms}, nicknames, radius)
    return v, _rare_aliases(told, noise, share) if share > CONTEXTS else None


def _rare_aliases(told: DataFrame, noise: frozenset[str], share: float) -> DataFrame:
    """w, meanings of the aliases that ``learn`` doesn't take to the driver, by the same rules."""
    short = F.udf(abbreviates, "boolean")
    right = told.where(~F.col("w").isin(*sorted(noise)) & ~F.col("of").isin(*sorted(noise))) if noise else told
    right = right.where((F.col("others") >= TIMES * F.col("contexts")) | short("w", "of")).select("w", "of", "contexts")
    again = right.select(F.col("w").alias("of"), F.col("of").alias("meant"))
    meant = right.where(F.col("contexts") < share).join(again, "of", "left").select("w", F.coalesce("meant", "of").alias("m")).where("w <> m")
    return meant.groupBy("w").agg(F.array_sort(F.collect_set("m")).alias("meanings"))


def forms(type_: str, words: list[str], v: Vocabulary, rare: Mapping[str, tuple[str, ...]] | None = None) -> list[tuple[str, str, int, bool]]:
    """(apart, form, rank, clean) of a name: rank 0 its own form, 1 the same words in another order, 2 a guess.

    apart: what must be equal besides. clean: all its words are established. rare: more aliases of its words.
    """
    known = ChainMap(v.aliases, rare) if rare else v.aliases
    words = [w for w in words if w not in v.noise] or words
    if type_ in PERSON_TYPES:
        return _person_forms(words, v, known)
    apart = sorted(w for w in words if is_apart(w))
    rest = [w for w in words if not is_apart(w)]
    joined, i = [], 0
    while i < len(rest):  # a kind word written as two
        two = rest[i] + rest[i + 1] if i + 1 < len(rest) else ""
        joined.append(two if two in v.kinds.get(type_, ()) else rest[i])
        i += 2 if joined[-1] == two else 1
    single = [known[w][0] if len(known.get(w, ())) == 1 else w for w in joined]
    keep = [w for w in single if v.kind_distance(w, type_)]
    if len(keep) == len(single) > 1:
        # no kind word: one that may be short for one or a slip of one, the nearest and last
        near = min(((v.kind_distance(w, type_), -i) for i, w in enumerate(single) if w not in v.firm or v.kind_distance(w, type_) == 1), default=(9, 0))
        if near[0] == 1 or (near[0] < 9 and len(single) > 2):
            keep = [w for i, w in enumerate(single) if i != -near[1]]
    keep = keep or single or words
    clean = all(w in v.firm for w in keep)
    turned = {"".join(keep[i:] + keep[:i]) for i in range(1, len(keep))} - {"".join(keep)}
    tag = " ".join(apart)
    out = [(tag, "".join(keep), 0, clean), *((tag, t, 1, clean) for t in sorted(turned))]
    if len(keep) > 1:
        for i, w in enumerate(keep):
            for long in known.get(w) or v.long_forms(w):
                other = [*keep[:i], long, *keep[i + 1 :]]
                out += [(tag, "".join(other[k:] + other[:k]), 2, all(x in v.firm for x in other)) for k in range(len(other))]
    return out


def _person_forms(words: list[str], v: Vocabulary, aliases: Mapping[str, tuple[str, ...]]) -> list[tuple[str, str, int, bool]]:
    """A name in its order and turned; either end may be the surname, so an initial is taken of either."""
    established = v.known  # a rare name near a frequent one is another name
    long = [w for w in words if len(w) > 1]
    if len(long) == 1 and len(words) > 1:  # initials and a surname
        first = next(w for w in words if len(w) == 1)
        return [("initial", first + long[0], 0, long[0] in established), ("initial", first + long[0], 2, long[0] in established)]
    long = long or words
    short = next((i for i, w in enumerate(long) if w in aliases and len(long) > 1), None)
    if short is not None:
        full, other = aliases[long[short]], long[:short] + long[short + 1 :]
        surname, clean = "".join(other), all(w in established for w in other)
        if len(full) == 1:
            return [("", full[0] + surname, 0, clean), ("", surname + full[0], 1, clean), ("initial", full[0][0] + surname, 1, clean)]
        return [("", long[short] + surname, 0, True), *(("", f + surname, 2, clean) for f in full)]
    clean = all(w in established for w in long)
    out = [("", "".join(long), 0, clean)]
    for i in range(1, len(long)):
        out.append(("", "".join(long[i:] + long[:i]), 1, clean))
    if len(long) > 1:
        out.append(("initial", long[0][0] + "".join(long[1:]), 1, all(w in established for w in long[1:])))
        out.append(("initial", long[-1][0] + "".join(long[:-1]), 1, all(w in established for w in long[:-1])))
        for i, w in enumerate(long):
            other = long[:i] + long[i + 1 :]
            out += [("", x + "".join(other), 2, all(y in established for y in other)) for x in v.long_forms(w)]
    return out


def _tokenizer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b.id, "type": b.type, "words": [words_of(n) for n in b.name]})


def _former(v: Vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for i, t, w, short, long in zip(b.id, b.type, b.words, b.short, b.long, strict=True):
                r = None if short is None else {x: tuple(y.split(" ")) for x, y in zip(short, long, strict=True)}
                out += [(i, t, *f) for f in forms(t, list(w), v, r)] if len(w) else []
                if len(out) >= 8 * AT_ONCE:  # a short word may have hundreds of readings
                    yield pd.DataFrame(out, columns=["id", "type", "apart", "form", "rank", "clean"])
                    out = []
            yield pd.DataFrame(out, columns=["id", "type", "apart", "form", "rank", "clean"])

    return run


# --- search --------------------------------------------------------------------------------------------------------

_ROW = "cell bigint, type string, apart string, form string, target boolean, clean boolean, probe boolean"
_MATCH = "type string, apart string, form string, other string, distance int, other_clean boolean"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows whose first ``keys`` columns (integers) are equal, gathered over batches."""
    rest: pa.Table | None = None
    for batch in (*batches, None):
        if batch is not None:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rest is None or not len(rest):
            continue
        key = np.stack([rest.column(k).to_numpy() for k in range(keys)])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        ends = [*cut.tolist(), *([len(rest)] if batch is None else [])]
        start = 0
        for end in ends:
            yield rest.slice(start, end - start)
            start = end
        rest = rest.slice(start)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pivots of each cell: of its sample, in the order of a checksum, each form that is far from all chosen before."""

    def far(texts: list[str], radius: int) -> list[str]:
        f = Forms(sorted(texts, key=lambda t: (zlib.crc32(t.encode()), t)))
        everyone, least, out = np.arange(len(f.texts)), np.full(len(f.texts), 1 << 30), []
        for k in range(len(f.texts)):
            if least[k] > 5 * radius and len(out) < PIVOTS:
                out.append(f.texts[k])
                least = np.minimum(least, distances(f, everyone, f, np.full(len(everyone), k)))
        return out

    for batch in batches:
        for k in range(len(batch)):  # one sample at a time
            cell, texts, radius, n = (batch.column(i)[k].as_py() for i in range(4))
            found = pa.array([far(texts, radius)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), found, pa.array([n], pa.int32())], names=["cell", "pivots", "n"])


def _divide(radius: int):
    """A probe goes to the cell of its nearest pivot; a target to those of all pivots at most 2 * radius farther than that.

    Rows (of _ROW and pivots) come in runs of a cell, each led by a row with its pivots; no more than AT_ONCE are held.
    """

    def divided(part: pa.RecordBatch, pivots: Forms) -> Iterator[pa.RecordBatch]:
        forms_, n = Forms(part.column("form").to_pylist()), len(pivots.texts)
        d = distances(forms_, np.repeat(np.arange(len(part)), n), pivots, np.tile(np.arange(n), len(part))).reshape(len(part), n)
        probe, target = (part.column(c).to_numpy(zero_copy_only=False) for c in ("probe", "target"))
        home = d.argmin(1)
        at_home = probe[:, None] & (np.arange(n) == home[:, None])
        reached = target[:, None] & (d <= d.min(1, keepdims=True) + 2 * radius)
        row, pivot = np.nonzero(at_home | reached)
        cell = part.column("cell").to_numpy()[row] * 1000003 + pivot + 1
        kept = part.select(["type", "apart", "form", "clean"]).take(pa.array(row))
        columns = [pa.array(cell), kept["type"], kept["apart"], kept["form"], pa.array(reached[row, pivot]), kept["clean"], pa.array(at_home[row, pivot])]
        yield from pa.table(columns, names=[c.split()[0] for c in _ROW.split(", ")]).to_batches(max_chunksize=8 * AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = Forms([])
        for batch in batches:
            leads = np.flatnonzero(batch.column("pivots").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for start, end in zip([-1, *leads], [*leads, len(batch)], strict=True):
                if start >= 0:
                    pivots = Forms(batch.column("pivots")[start].as_py())
                for k in range(start + 1, end, AT_ONCE):
                    yield from divided(batch.slice(k, min(AT_ONCE, end - k)), pivots)

    return run


def _searcher(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 2):
            probe, target = (np.flatnonzero(part.column(c).to_numpy(zero_copy_only=False)) for c in ("probe", "target"))
            if not len(probe) or not len(target):
                continue
            texts = part.column("form").to_pylist()
            p, t = Forms([texts[k] for k in probe]), Forms([texts[k] for k in target])
            most = np.where(p.length > 8, radius, 1)  # a short name may hold one slip only
            for i, j, d in near_pairs(p, t, most):
                i, j, d = (x[d > 0] for x in (i, j, d))
                for s in range(0, len(i), 8 * AT_ONCE):
                    some = slice(s, s + 8 * AT_ONCE)
                    left, right = part.take(pa.array(probe[i[some]])), part.take(pa.array(target[j[some]]))
                    columns = [left["type"], left["apart"], left["form"], right["form"], pa.array(d[some].astype(np.int32)), right["clean"]]
                    yield from pa.table(columns, names=[c.split()[0] for c in _MATCH.split(", ")]).to_batches()

    return run


def near_forms(kinds: DataFrame, scratch: Scratch, radius: int = RADIUS, crowded: int = CROWDED, side: int = SIDE) -> DataFrame:
    """type, apart, form, other, distance, other_clean: all targets within the radius of each probe of one type and apart.

    kinds: type, apart, form (unique together), target, clean, probe. Cells of more than ``crowded`` pairs are divided
    by pivots chosen from a sample of each; what is crowded after LEVELS divisions is compared in blocks of ``side``
    targets and probes. Nothing of this passes through the driver.
    """
    rows = kinds.where("target or probe").select(F.xxhash64("type", "apart").alias("cell"), *[c.split()[0] for c in _ROW.split(", ")[1:]])
    parts = 2 * kinds.sparkSession.sparkContext.defaultParallelism
    done: list[DataFrame] = []
    for _ in range(LEVELS):
        size = rows.groupBy("cell").agg(F.count_if("target").alias("t"), F.count_if("probe").alias("p"))
        share, tasks = F.lit(SAMPLE) / (F.col("t") + F.col("p")) * (1 << 30), F.ceil((F.col("t") + F.col("p")) / SHARED).cast("int")
        large = scratch.cut(size.where(F.col("t") * F.col("p") > crowded).select("cell", share.alias("limit"), tasks.alias("n")))
        if not large.limit(1).count():
            break
        done.append(rows.join(large, "cell", "left_anti"))
        some = rows.join(large, "cell").where(F.pmod(F.xxhash64("form", F.lit(7)), F.lit(1 << 30)) < F.col("limit"))
        some = some.groupBy("cell", "n").agg(F.collect_set("form").alias("texts")).select("cell", "texts", F.lit(radius), "n")
        pivots = scratch.cut(some.mapInArrow(_choose, "cell bigint, pivots array<string>, n int").where("size(pivots) > 0"))
        done.append(rows.join(large, "cell", "left_semi").join(pivots, "cell", "left_anti"))
        # a cell's rows go to as many tasks as they fill, and its pivots once to each
        lead = pivots.select("cell", "pivots", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
        moved = rows.join(pivots.select("cell", "n"), "cell").withColumn("part", F.pmod(F.xxhash64("form"), "n").cast("int")).drop("n")
        moved = moved.unionByName(lead, allowMissingColumns=True).repartition(max(parts, int(pivots.agg(F.sum("n")).first()[0] or 0) // 8), "cell", "part")
        moved = moved.sortWithinPartitions("cell", "part", F.col("pivots").isNull()).drop("part")
        rows = scratch.cut(moved.mapInArrow(_divide(radius), _ROW))
    for x in done:
        rows = rows.unionByName(x.select(rows.columns))
    size = rows.groupBy("cell").agg(F.count_if("target").alias("t"), F.count_if("probe").alias("p")).where("t > 0 and p > 0")
    blocks = size.select("cell", F.ceil(F.col("t") / side).cast("int").alias("tb"), F.ceil(F.col("p") / side).cast("int").alias("pb"))
    own = rows.join(blocks, "cell").withColumn("h", F.xxhash64("form"))
    t, p = F.pmod("h", "tb").cast("int"), F.pmod("h", "pb").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["cell", "block", "type", "apart", "form", "target", "clean", "probe"]
    targets = own.where("target").withColumn("q", every("pb")).withColumn("block", t * F.col("pb") + F.col("q")).withColumn("probe", F.lit(False))
    probes = own.where("probe").withColumn("q", every("tb")).withColumn("block", F.col("q") * F.col("pb") + p).withColumn("target", F.lit(False))
    placed = targets.select(cols).unionByName(probes.select(cols)).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block")
    return placed.mapInArrow(_searcher(radius), _MATCH).distinct()


def name_groups(rows: DataFrame, key: str = "id", name: str = "name", type_: str = "entity_type", radius: int = RADIUS, nicknames: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """id, group_id: ids whose names are spellings of one thing, with the least id of the set; lone ids have no row.

    Types are compared trimmed and without case. Rows with a null id, name or type, and names without a letter or
    digit, link nothing; a row repeated counts once; an id with several names belongs to the set of each. A guess (an
    initial, a short form of several long ones) links only if one set of full names fits. An empty table gives an empty
    result. Kind words, noise, short forms and nicknames are learned from the names; ``nicknames`` (short form to full
    ones), a public list for instance, adds to them. Only words above shares of the names reach the driver.
    """
    scratch = Scratch(rows.sparkSession, "names")
    given = rows.select(F.col(key).cast("string").alias("id"), F.lower(F.trim(F.col(type_), F.lit(" \t\r\n"))).alias("type"), F.col(name).alias("name"))
    given = given.where("id is not null and type is not null and name is not null").distinct()
    words = scratch.cut(given.mapInPandas(_tokenizer, "id string, type string, words array<string>").where("size(words) > 0"))
    v, rare = learn(words, scratch, nicknames, radius)
    said = words.withColumns({c: F.lit(None).cast("array<string>") for c in ("short", "long")})
    if rare is not None and (rare := scratch.cut(rare)).limit(1).count():
        own = words.select("id", "type", "words", F.explode(F.array_distinct("words")).alias("w")).join(rare, "w").groupBy("id", "type", "words")
        own = own.agg(F.collect_list(F.struct("w", F.array_join("meanings", " ").alias("m"))).alias("x"))
        said = words.join(own.select("id", "type", "words", F.col("x.w").alias("short"), F.col("x.m").alias("long")), ["id", "type", "words"], "left")
    views = scratch.cut(said.mapInPandas(_former(v), "id string, type string, apart string, form string, rank int, clean boolean"))
    # one row a form: as a target it is someone's own or turned form, as a probe an own form or a guess with a word that isn't established
    kinds = views.groupBy("type", "apart", "form").agg(
        F.bool_or(F.col("rank") < 2).alias("target"), F.bool_and("clean").alias("clean"), F.bool_or((F.col("rank") != 1) & ~F.col("clean")).alias("probe")
    )
    kinds = scratch.cut(kinds)
    matches = scratch.cut(near_forms(kinds, scratch, radius))
    at = ["type", "apart", "form"]
    # the nearest established spellings, or else all others
    nearest = matches.where("other_clean").groupBy(*at).agg(F.min("distance").alias("least"))
    taken = matches.join(nearest, at, "left").where("least is null or (other_clean and distance = least)").select(*at, "other")
    same = kinds.where("target").select(*at, F.col("form").alias("other"))
    reach = scratch.cut(taken.unionByName(same))
    # links go through one id of each form, so their number follows the names and not their pairs
    own = views.where("rank = 0").groupBy(*at).agg(F.min("id").alias("hub"))
    turned = views.where("rank = 1").groupBy(*at).agg(F.min("id").alias("hub"))
    hubs = own.withColumn("r", F.lit(0)).unionByName(turned.withColumn("r", F.lit(1)))
    others = hubs.select("type", "apart", F.col("form").alias("other"), F.col("hub").alias("b"), "r")
    mine = views.where("rank = 0").select(*at, F.col("id").alias("a"))
    firm = mine.join(reach, at).join(others, ["type", "apart", "other"])
    # turned forms that several names share mean one thing only if it's someone's own order
    initials = F.col("apart") == "initial"
    person = F.col("type").isin(*sorted(PERSON_TYPES))
    own_links = firm.where(~(person & initials) | (F.col("r") == 0)).select("a", "b")
    to_hub = views.where("rank < 2").where(~(person & initials)).join(own, at).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    lone = mine.select("a", F.col("a").alias("b"))
    comps = scratch.cut(connected_components(scratch.cut(own_links.unionByName(to_hub).unionByName(lone).distinct())))
    # guesses: the sets of all full names that fit
    all_named = views.where("rank < 2").select("type", "apart", F.col("form").alias("other"), F.col("id").alias("b"), "rank")
    fits = views.where("rank = 2").select(*at, F.col("id").alias("a")).join(reach.unionByName(same).distinct(), at).join(all_named, ["type", "apart", "other"])
    fits = fits.where((initials & (F.col("rank") == 1)) | (~initials & (F.col("rank") == 0))).where("a <> b")
    of = comps.select("id", "group_id")
    targets = fits.select("a", "b").join(of.select(F.col("id").alias("b"), F.col("group_id").alias("gb")), "b").join(of.select(F.col("id").alias("a"), F.col("group_id").alias("ga")), "a")
    single = targets.where("ga <> gb").groupBy("ga").agg(F.min("gb").alias("x"), F.max("gb").alias("y")).where("x = y").select(F.col("ga").alias("a"), F.col("x").alias("b"))
    merged = scratch.cut(connected_components(scratch.cut(single.unionByName(comps.select(F.col("group_id").alias("a"), F.col("group_id").alias("b"))))))
    out = comps.join(merged.select(F.col("id").alias("group_id"), F.col("group_id").alias("g")), "group_id").select("id", F.col("g").alias("group_id"))
    several = out.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return out.join(several, "group_id", "left_semi").select("id", "group_id")


def name_pairs(groups: DataFrame) -> DataFrame:
    """id_a, id_b: all pairs of each set of spellings, smaller id first."""
    a, b = groups.select(F.col("id").alias("id_a"), "group_id"), groups.select(F.col("id").alias("id_b"), "group_id")
    return a.join(b, "group_id").where("id_a < id_b").select("id_a", "id_b")
