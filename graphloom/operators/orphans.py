"""References to records that do not exist, reported per table, field and period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import Scratch

#: Size bound of one broadcast filter: 2**27 bits are 16 MB. Keys beyond BITS_PER_KEY of them are divided into shards.
MAX_FILTER_BITS, BITS_PER_KEY = 1 << 27, 10
HASHES = 4


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` refer by ``column`` to ``parent.key``; ``loaded_at`` is the time column of either side."""

    table: str
    child: DataFrame
    column: str
    parent_name: str
    parent: DataFrame
    key: str
    loaded_at: str = "loaded_at"
    deleted: str = "is_deleted"


def key_form(c: Column) -> Column:
    """Blanks and tabs trimmed, lower case; null where nothing is left."""
    return F.nullif(F.lower(F.trim(c, F.lit(" \t"))), F.lit(""))


def _bits(key: Column, n_bits: int) -> list[Column]:
    """Bit numbers of a key: two 64-bit hashes, combined as h1 + i * h2."""
    h1, h2 = F.shiftrightunsigned(F.xxhash64(key), 2), F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 4)
    return [F.pmod(h1 + F.lit(i) * h2, F.lit(n_bits).cast("long")) for i in range(HASHES)]


def bloom_words(keys: DataFrame, n_bits: int) -> DataFrame:
    """One row with the filter as an array of 64-bit words; partial ORs run before the only shuffle.

    The array has n_bits / 64 longs, whatever the number of keys.
    """
    words = keys.select(F.explode(F.array(*_bits(F.col("key"), n_bits))).alias("bit")).select(
        F.expr("bit div 64").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("v")
    )
    empty = keys.sparkSession.range(n_bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    filled = words.unionByName(empty).groupBy("w").agg(F.bit_or("v").alias("v"))
    return filled.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("x")).select(F.col("x.v").alias("bloom"))


def might_contain(key: Column, bloom: Column, n_bits: int) -> Column:
    """False only for a key that certainly isn't in the filter."""
    hit = F.lit(True)
    for bit in _bits(key, n_bits):
        word = F.get(bloom, (bit / 64).cast("int"))
        hit = hit & (F.call_function("getbit", word, (bit % 64).cast("int")) == 1)
    return hit


def key_states(ref: Reference) -> DataFrame:
    """key, first (earliest load), deleted (state of the latest load). Of rows loaded at one time, a deletion counts."""
    p = ref.parent.select(
        key_form(F.col(ref.key)).alias("key"), F.col(ref.loaded_at).alias("at"), F.col(ref.deleted).alias("gone")
    ).where("key is not null")
    last = F.max(F.struct(F.col("at"), F.coalesce(F.col("gone"), F.lit(False)).alias("gone")))
    return p.groupBy("key").agg(F.min("at").alias("first"), last["gone"].alias("deleted"))


def filter_bits(n_keys: int) -> int:
    """Bits of a filter for so many keys: a power of two with BITS_PER_KEY for each, so 1 in 80 others passes."""
    return min(1 << max(12, (BITS_PER_KEY * max(n_keys, 1) - 1).bit_length()), MAX_FILTER_BITS)


def mark(rows: DataFrame, column: str, keys: DataFrame, scratch: Scratch, most: int = MAX_FILTER_BITS, n_bits: int | None = None) -> DataFrame:
    """``rows``, written once, with ``maybe``: false if their non-null ``column`` certainly isn't among ``keys`` (key).

    The filter is broadcast. If it would take more than ``most`` bits, keys and rows are divided by a hash of the key
    into shards with a filter of at most that size each; the rows are written by shard, so each is read once with the
    one filter it needs, and the share of others that pass stays the same for any number of keys.
    """
    n = keys.select(F.approx_count_distinct("key")).first()[0]
    shards = 1 if n_bits else max(1, -(-BITS_PER_KEY * n // most))
    if shards == 1:
        bits = n_bits or min(filter_bits(n), most)
        bloom = scratch.cut(bloom_words(keys, bits))
        return scratch.cut(rows.withColumn("maybe", might_contain(F.col(column), bloom.scalar(), bits)))
    shard = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(2)), F.lit(shards)).cast("int").alias("_shard")
    by_row = scratch.cut(rows.withColumn("_shard", shard(column)), partition_by="_shard")
    by_key = scratch.cut(keys.withColumn("_shard", shard("key")), partition_by="_shard")
    out = None
    for k in range(shards):
        bloom = scratch.cut(bloom_words(by_key.where(F.col("_shard") == k).select("key"), most))
        part = by_row.where(F.col("_shard") == k).drop("_shard").withColumn("maybe", might_contain(F.col(column), bloom.scalar(), most))
        out = part if out is None else out.unionByName(part)
    return scratch.cut(out)


def orphan_references(refs: list[Reference], n_bits: int | None = None, most: int = MAX_FILTER_BITS) -> DataFrame:
    """Distinct orphan references: ref_table, ref_column, ref_key, ref_month, reason.

    reason is ``missing`` (no row has the key), ``deleted`` (the key's latest row is a deletion) or ``late`` (the key
    was first loaded after the referring row). Null or blank references are none; a referring row without a time has
    a null month and is never late; parents without a time never make a reference late. Repeated rows count once.

    Hot keys: references are first reduced to (key, month, earliest load) with partial aggregation, which keeps the
    result whole, since a key is late in a month exactly if its earliest reference of that month is. A Bloom filter
    of the parent keys, broadcast in shards of at most ``most`` bits, proves nearly all missing keys without a shuffle;
    only positives are joined with the exact key states. ``n_bits`` sets the size of a single filter instead.
    """
    out = None
    scratch = Scratch(refs[0].child.sparkSession, "orphans") if refs else None
    states: dict[str, DataFrame] = {}
    by_parent: dict[str, list[Reference]] = {}
    for r in refs:
        by_parent.setdefault(r.parent_name, []).append(r)
        states.setdefault(r.parent_name, key_states(r))
    for name, group in by_parent.items():
        keyed = None
        for r in group:
            one = r.child.select(
                F.lit(r.table).alias("ref_table"), F.lit(r.column).alias("ref_column"),
                key_form(F.col(r.column)).alias("ref_key"), F.col(r.loaded_at).alias("at"),
            )
            keyed = one if keyed is None else keyed.unionByName(one)
        keyed = (
            keyed.where("ref_key is not null")
            .groupBy("ref_table", "ref_column", "ref_key", F.date_format("at", "yyyy-MM").alias("ref_month"))
            .agg(F.min("at").alias("at"))
        )
        first = group[0]
        keys = first.parent.select(key_form(F.col(first.key)).alias("key")).where("key is not null")
        # both branches read the marked references, so these are written once instead of being made twice
        marked = mark(keyed, "ref_key", keys, scratch, most, n_bits)
        cols = ("ref_table", "ref_column", "ref_key", "ref_month", "reason")
        sure = marked.where(~F.col("maybe")).withColumn("reason", F.lit("missing")).select(*cols)
        reason = (
            F.when(F.col("key").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("first") > F.col("at"), "late")
        )
        checked = (
            marked.where("maybe")
            .join(states[name], F.col("ref_key") == F.col("key"), "left")
            .withColumn("reason", reason)
            .where("reason is not null")
            .select(*cols)
        )
        part = sure.unionByName(checked)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no references given")
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan keys counted by table, field, month and reason."""
    return orphans.groupBy("ref_table", "ref_column", "ref_month", "reason").agg(F.count("*").alias("n_keys"))
