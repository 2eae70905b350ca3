"""Hierarchies against a model that walks every node, in one partition and in many."""

import random

import pytest

from graphloom.operators import hierarchy as H


def model(rows):
    up = {i: p for i, p, *_ in rows}
    up = {i: (p if p in up else None) for i, p in up.items()}
    kids = {}
    for i, p in up.items():
        kids.setdefault(p, []).append(i)
    out = set()
    for i in up:
        seen, x = [], i
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        ring = seen[seen.index(x) :] if x is not None else []
        root, depth = (seen[-1], len(seen) - 1) if x is None else (min(ring), -1 if i in ring else -2)
        below, todo = {i}, [i]
        while todo:
            new = [z for z in kids.get(todo.pop(), []) if z not in below]
            below.update(new)
            todo += new
        out.add((i, root, depth, len(below) - 1))
    return out


def links(spark, rows):
    return spark.createDataFrame([(i, p, None) for i, p in rows], "id string, parent string, near string")


IDS = [f"{i:02d}" for i in range(40)]
RANDOM = random.Random(5)
HUB = [("hub", "top"), ("top", None), *((f"k{i}", "hub") for i in range(20)), *((f"m{i}", f"k{i}") for i in range(9)), ("x0", "x1"), ("x1", "x2"), ("x2", "x0"), *((f"y{i}", "x1") for i in range(6))]
CASES = {
    "hub": HUB,
    "random": [(i, RANDOM.choice([*IDS, None, "gone", ""])) for i in IDS],
    "chain": [(a, b) for a, b in zip(IDS, [None, *IDS], strict=False)],
    "one ring": [(a, b) for a, b in zip(IDS, [IDS[-1], *IDS], strict=False)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("rows_per_part", [1000, 9, 4])
def test_whole_forest(spark, name, rows_per_part):
    got = H.hierarchy(links(spark, CASES[name]), rows_per_part)
    assert dict(got.dtypes) == {"document_id": "string", "root_id": "string", "tree_depth": "int", "n_descendants": "bigint"}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(CASES[name]) and set(rows) == model(CASES[name])


def test_larger_forests_are_contracted_and_expanded(spark):
    rnd = random.Random(9)
    ids = [f"{rnd.randrange(10**9):09d}" for _ in range(1500)]  # parents are nowhere near their children
    rows = [(x, None if i % 100 == 0 else ids[rnd.randrange(max(0, i - 7), i)]) for i, x in enumerate(ids)]
    rows += [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [(f"s{i}", f"r{i % 40}") for i in range(60)]
    got = H.hierarchy(links(spark, rows))
    assert {tuple(r) for r in got.collect()} == model(rows)
    assert {tuple(r) for r in H.hierarchy(links(spark, rows), 60).collect()} == model(rows)


def test_empty_and_self(spark):
    assert H.hierarchy(links(spark, [("x", "x")])).collect()[0].tree_depth == -1
    assert H.hierarchy(links(spark, [("x", "x")]).limit(0)).count() == 0


def test_paths_and_descendants(spark):
    df = links(spark, [("a", None), ("b", "a"), ("c", "b"), ("r", "s"), ("s", "r"), ("t", "r")])
    solved = H.hierarchy(df)
    paths = {r[0]: r[1] for r in H.paths(df, solved).collect()}
    assert paths == {"a": "a", "b": "a > b", "c": "a > b > c", "r": "r", "s": "s", "t": "r > t"}


@pytest.mark.parametrize("name", [*CASES, "loops"])
def test_all_descendants(spark, name):
    rows = CASES.get(name) or [("a", None), ("b > c", "a"), ("d", "b > c"), ("r", "s"), ("s", "q"), ("q", "r"), ("t", "s"), ("u", "t"), ("z", "z")]
    up = {i: p for i, p in rows}
    want = {}
    for i in up:
        x, n = up[i], 1
        while x in up and (x, i) not in want:
            want[x, i] = n
            x, n = up[x], n + 1
    df = links(spark, rows)
    solved = H.hierarchy(df)
    got = [tuple(r) for r in H.all_descendants(df, solved).collect()]
    assert len(got) == len(set(got)) and set(got) == {(*k, n) for k, n in want.items() if k[0] != k[1]}
    for r in solved.collect():
        assert r.n_descendants == sum(g[0] == r.document_id for g in got)


def test_latest_pages(spark):
    rows = [("p", "x", 1, "s"), ("p", " y ", 3, "s"), ("p", " y ", 3, "s"), ("q", None, 1, None), (None, "p", 1, "s")]
    df = spark.createDataFrame(rows, "document_id string, parent_page_id string, version int, space_key string")
    got = {r.id: r.parent for r in H.latest_pages(df, "document_id", "parent_page_id", "version", "space_key").collect()}
    assert got == {"p": "y", "q": None}
