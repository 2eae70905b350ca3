"""Sections and pieces against a whole-text model, with ranges much smaller than the texts."""

import random
import re

from graphloom.llm import pieces as P


def words(s):
    return [w for w in re.split("[ \t\r\n]+", s) if w]


def model(text):
    out, path = [[0, "", 0]], []
    for line in text.split("\n"):
        m = re.match("#{1,6} ", line)
        if m:
            level = len(m[0]) - 1
            path = [*path[: level - 1], *[""] * (level - 1 - len(path)), line[level:].strip()]
            out.append([len(out), " > ".join(p for p in path if p), 0])
        else:
            out[-1][2] += len(words(line))
    return [tuple(x) for x in out]


def texts():
    rnd = random.Random(7)
    bits = ["word", "ä", "long-er", "# Head", "\n", "\n\n", "\r\n", "## Two of\tthem", "\n#### Deep\n", "####### no", "\t", "end.", "Ünï", "\n# \n", "\n```\n# code\n", "x" * 90]
    return [(f"d{i}", " ".join(rnd.choice(bits) for _ in range(rnd.randrange(90))).replace("\n ", "\n")) for i in range(60)] + [("empty", ""), ("null", None), ("long", "word " * 5000)]


def items(spark, rows):
    return spark.createDataFrame([(a, b, True) for a, b in rows], "item string, text string, sectioned boolean")


def test_sections_by_range_equal_the_whole_text(spark):
    rows = texts()
    got = P.section_paths(P.sections(items(spark, rows + rows[:5]), length=64, halo=2000)).select("item", "section_no", "section_path", "words").collect()
    expected = {(k, n): (p, w) for k, t in rows if t is not None for n, p, w in model(t)}
    assert {(r[0], r[1]): r[3] for r in got} == {k: w for k, (_, w) in expected.items()}
    assert {(r[0], r[1]): r[2] for r in got} == {k: p for k, (p, _) in expected.items()}
    assert len(got) == len(expected)


def test_titles_and_words_longer_than_ranges(spark):
    title = "a very long title of many words " * 20
    rows = [("a", f"x y\n## {title}\nbody of it\n# B\nend"), ("b", "z" * 500 + " and\n" + "# " + "q" * 300)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in P.section_paths(P.sections(items(spark, rows), length=50, halo=10)).select("item", "section_no", "section_path", "words").collect()}
    assert got == {("a", 0): ("", 2), ("a", 1): (title.strip(), 3), ("a", 2): ("B", 1), ("b", 0): ("", 2), ("b", 1): ("q" * 300, 0)}
    rows = [("a", " ".join(["w" * 130] * 30))]
    large = P.sections(items(spark, rows), length=100, halo=20).select("item", "section_no", "body", "end", "words")
    pieces = sorted(P.split_sections(items(spark, rows), large, max_tokens=8, overlap_tokens=2, length=100, halo=20).collect(), key=lambda r: r.piece_no)
    assert all(len(words(r.content)) * 4 // 3 == r.token_count <= 8 for r in pieces) and pieces[0].start == 0 and pieces[-1].end == len(rows[0][1])
    assert all(a.start < b.start <= a.end for a, b in zip(pieces, pieces[1:], strict=False)) and all(set(r.content) == {"w", " "} for r in pieces)


def test_unsectioned_items_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "# x\ny z", False)], "item string, text string, sectioned boolean")
    assert [(r.section_no, r.words) for r in P.sections(df).collect()] == [(0, 4)]
    assert P.sections(df.limit(0)).count() == 0


def test_pieces_cover_the_section_and_keep_the_limits(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(12):
        body = "".join(f"w{k}" + rnd.choice([" ", " ", " ", ". ", "\n", ".\n\n", "\t"]) for k in range(rnd.randrange(50, 900)))
        rows.append((f"d{i}", f"intro text\n# Title {i}\n" + body + "\n## Next\nshort"))
    df = items(spark, rows)
    for length, halo in ((1 << 18, 1 << 12), (300, 60)):
        parts = P.sections(df, length, halo)
        large = parts.where("words > 60").select("item", "section_no", "body", "end", "words")
        got = P.split_sections(df, large, max_tokens=80, overlap_tokens=10, length=length, halo=halo).collect()
        by = {}
        for r in got:
            by.setdefault((r.item, r.section_no), []).append(r)
        text = dict(rows)
        for r in large.collect():
            own = sorted(by.pop((r.item, r.section_no)), key=lambda x: x.piece_no)
            body = words(text[r.item][r.body : r.end])
            at = 0
            for k, x in enumerate(own):
                w = words(x.content)
                assert x.token_count == len(w) * 4 // 3 <= 80
                i = body.index(w[0])
                assert body[i : i + len(w)] == w
                assert (i == 0) if k == 0 else i <= at and (at - i) * 4 // 3 <= 10
                at = i + len(w)
            assert at == len(body)
        assert not by


def test_limits():
    assert P.words_within(800) == 600 and P.words_within(100) == 75
    for n in range(1, 2000):
        assert (P.words_within(n) * 4 // 3 <= n) and ((P.words_within(n) + 1) * 4 // 3 > n)
