"""Orphan references against a model, with null, blank, repeated and hot keys."""

import datetime as dt
import random

from graphloom.operators import orphans as O
from graphloom.scratch import Scratch


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def frames(spark, refs, keys):
    child = spark.createDataFrame(refs, "ref string, loaded_at timestamp, clash string")
    parent = spark.createDataFrame(keys, "id string, loaded_at timestamp, is_deleted boolean, clash string")
    return [O.Reference("child", child, "ref", "parent", parent, "id")]


def plain(x):
    x = x.strip(" \t").lower() if x is not None else None
    return x or None


def model(refs, keys):
    state = {}
    for k, at, gone, _ in keys:
        if plain(k):
            state.setdefault(plain(k), []).append((at, bool(gone)))
    out = set()
    for r, at, _ in refs:
        k = plain(r)
        if not k:
            continue
        rows = [x for x in state.get(k, []) if x[0] is not None]
        reason = None
        if k not in state:
            reason = "missing"
        elif rows and max(rows)[1]:
            reason = "deleted"
        elif rows and at is not None and min(rows)[0] > at:
            reason = "late"
        if reason:
            out.add(("child", "ref", k, at.strftime("%Y-%m") if at else None, reason))
    return out


def test_random_references(spark):
    rnd = random.Random(1)
    names = [f"k{i}" for i in range(40)]
    wild = lambda k: rnd.choice([k, k.upper(), f" {k}\t", k])
    keys = [(wild(rnd.choice(names)), day(rnd.randrange(90)), rnd.random() < 0.3, "x") for _ in range(60)] + [(None, day(1), False, "x"), ("  ", day(1), False, "x")]
    refs = [(wild(rnd.choice([*names, "k99", "hot", "hot"])), rnd.choice([None, day(rnd.randrange(90))]), "y") for _ in range(400)] + [(None, day(1), "y"), ("\t", day(1), "y")]
    expected = model(refs, keys)
    assert {r[4] for r in expected} == {"missing", "deleted", "late"}
    for bits in (None, 64):  # with a filter this small nearly every key is a false positive
        for most in (O.MAX_FILTER_BITS, 128):  # 128: some four shards
            got = [tuple(r) for r in O.orphan_references(frames(spark, refs, keys), bits, most).collect()]
            assert len(got) == len(set(got)) and set(got) == expected


def test_shards_keep_the_rate_of_false_positives(spark):
    keys = spark.range(20_000).selectExpr("cast(id as string) as key")
    rows = spark.range(30_000).selectExpr("cast(id as string) as k").unionByName(spark.createDataFrame([(None,)], "k string"))
    for most in (O.MAX_FILTER_BITS, 1 << 15):  # one filter, and seven
        marked = O.mark(rows, "k", keys, Scratch(spark, "t"), most)
        assert marked.count() == 30_001 and marked.where("maybe and cast(k as int) < 20000").count() == 20_000
        assert marked.where("maybe and cast(k as int) >= 20000").count() < 0.05 * 10_000


def test_empty_tables(spark):
    assert O.orphan_references(frames(spark, [], [])).count() == 0
    got = O.orphan_references(frames(spark, [("a", day(0), "y")], [])).collect()
    assert [tuple(r) for r in got] == [("child", "ref", "a", "2025-01", "missing")]
    assert O.orphan_report(O.orphan_references(frames(spark, [("a", day(0), "y"), ("b", day(0), "y")], []))).first().n_keys == 2
