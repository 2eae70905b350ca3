"""Most similar vectors for every vector, by cross-polytope hashing with multiprobe tables.

A unit vector is turned by fast pseudo-random rotations (sign flips and Hadamard transforms) and assigned to the
nearest signed axis; a few such hashes together name a bucket. Each table holds a vector in its own bucket and in the
next best one, and all vectors that meet in a bucket are compared, so the best of all tables need no further look at
the vectors. Vectors travel as codes of 16 bits a coordinate, with which cosines are right to some 2e-5. Crowded
buckets are compared in blocks, whatever their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.scratch import Scratch

#: Tables, and vectors that a bucket should hold at most by choice of the number of hashes.
TABLES, BUCKET = 5, 64
#: Members from which a bucket is crowded, from which its blocks grow with it, their side up to there and at most, and cosines held at once.
HOT, WHOLE, SIDE, WIDEST, HELD = 4096, 1 << 16, 2048, 1 << 15, 1 << 22
#: Vectors that are searched for at once where the tables gave too few.
QUERIES = 4096
#: Codes a unit vector's coordinate has on either side of 0.
SCALE = 32767


def _transform(x: np.ndarray) -> np.ndarray:
    """Hadamard transform of rows whose length is a power of two, keeping norms."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x * np.float32(1 / math.sqrt(d))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random rotation of rows: three rounds of sign flips and transform; rows are padded to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    if d > x.shape[1]:
        x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = _transform(x * rng.choice(np.array([-1, 1], np.float32), d))
    return x


def buckets(x: np.ndarray, table: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of rows: own and next best (one hash replaced, where that loses least)."""
    own = np.zeros(len(x), np.uint64)
    first, second, loss = [], [], []
    rows = np.arange(len(x))
    for k in range(hashes):
        y = rotate(x, 1 + table * 64 + k)
        size = np.abs(y)
        a = size.argmax(1)
        best = size[rows, a].copy()
        first.append((a * 2 + (y[rows, a] < 0)).astype(np.uint64))
        size[rows, a] = -1
        b = size.argmax(1)
        second.append((b * 2 + (y[rows, b] < 0)).astype(np.uint64))
        loss.append(best**2 - size[rows, b] ** 2)
    least = np.argmin(np.stack(loss), axis=0)
    width = np.uint64(2 * y.shape[1])
    probe = own.copy()
    for k in range(hashes):
        own = own * width + first[k]
        probe = probe * width + np.where(least == k, second[k], first[k])
    return own, probe


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _decoded(codes: pa.Array) -> np.ndarray:
    """Unit vectors of codes of one length."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    flat = np.frombuffer(b"".join(codes.to_pylist()), "<i2").astype(np.float32)
    x = flat.reshape(len(codes), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of unit vectors."""
    for batch in batches:
        if not len(batch):
            continue
        size = batch.column(2).value_lengths().to_numpy()
        for d in np.unique(size):
            part = batch.filter(pa.array(size == d))
            x = _matrix(part.column(2)).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            code = np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * SCALE).astype("<i2")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "model", "q"])


_CODED = "uid bigint, q binary, b array<bigint>"


def _coded(uid: pa.Array, q: pa.Array, keys: list[np.ndarray]) -> pa.RecordBatch:
    both = np.stack(keys, axis=1).view(np.int64)
    offsets = np.arange(len(both) + 1, dtype=np.int32) * both.shape[1]
    return pa.RecordBatch.from_arrays([uid, q, pa.ListArray.from_arrays(pa.array(offsets), pa.array(both.ravel()))], names=["uid", "q", "b"])


def _hasher(numbers: dict[str, tuple[int, int]], tables: int):
    """Codes with the buckets of all tables. numbers: model -> (number, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.asarray(batch.column(1).to_pylist(), dtype=object)
            for m in sorted(set(models.tolist())):
                part = batch.filter(pa.array(models == m))
                x, (number, hashes) = _decoded(part.column(2)), numbers[m]
                keys = [(code * np.uint64(tables) + np.uint64(t)) * np.uint64(len(numbers)) + np.uint64(number) for t in range(tables) for code in buckets(x, t, hashes)]
                yield _coded(part.column(0), part.column(2), keys)

    return run


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


_FOUND = "uid bigint, c array<struct<s:float,b:bigint>>"


def _emit(uid: list[np.ndarray], near: list[np.ndarray], sims: list[np.ndarray], count: list[np.ndarray]) -> pa.RecordBatch:
    structs = pa.StructArray.from_arrays([pa.array(np.concatenate(sims)), pa.array(np.concatenate(near))], names=["s", "b"])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(count))]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(uid)), pa.ListArray.from_arrays(pa.array(offsets), structs)], names=["uid", "c"])


def _comparer(k: int):
    def best(ids: np.ndarray, x: np.ndarray, out: list[list]) -> None:
        ids, first = np.unique(ids, return_index=True)  # own and probed bucket may be one
        x = x[first]
        if len(ids) < 2:
            return
        step = max(16, min(1024, HELD // len(ids)))
        for a in range(0, len(ids), step):
            sims = x[a : a + step] @ x.T
            rows = np.arange(len(sims))
            sims[rows, rows + a] = -2
            top = _top(sims, min(k, len(ids) - 1))
            out[0].append(ids[a : a + step])
            out[1].append(ids[top].ravel())
            out[2].append(np.take_along_axis(sims, top, 1).ravel())
            out[3].append(np.full(len(sims), top.shape[1], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in (*batches, None):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                rest = table if rest is None else pa.concat_tables([rest, table])
                key = rest.column(0).to_numpy()
                if len(key) < 4096 or key[0] == key[-1]:
                    continue
                stop = int(np.flatnonzero(key != key[-1])[-1]) + 1
                done, rest = rest.slice(0, stop), rest.slice(stop)
            elif rest is None:
                break
            else:
                done, rest = rest, None
            out: list[list] = [[], [], [], []]
            key, uid, codes = done.column(0).to_numpy(), done.column(1).to_numpy(), done.column(2)
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1:
                    best(uid[a:b], _decoded(codes.slice(a, b - a)), out)
            if out[0]:
                yield _emit(*out)

    return run


def _block_search(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Best k of each partition for given vectors of a model: number -> (uids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {m: (np.full((len(ids), k), -2, np.float32), np.full((len(ids), k), -1, np.int64)) for m, (ids, _) in queries.items()}
        for batch in batches:
            number, uid = (batch.column(i).to_numpy() for i in range(2))
            for m, (ids, x) in queries.items():
                on = np.flatnonzero(number == m)
                if not len(on):
                    continue
                vectors, others, (sim, near) = _decoded(batch.column(2).take(pa.array(on))).T, uid[on], best[m]
                for a in range(0, len(ids), 512):
                    part = slice(a, a + 512)
                    sims = x[part] @ vectors
                    sims[ids[part, None] == others[None, :]] = -2
                    top = _top(sims, min(k, len(on)))
                    s = np.concatenate([sim[part], np.take_along_axis(sims, top, 1)], axis=1)
                    b = np.concatenate([near[part], others[top]], axis=1)
                    top = _top(s, k)
                    sim[part], near[part] = np.take_along_axis(s, top, 1), np.take_along_axis(b, top, 1)
        out: list[list] = [[], [], [], []]
        for m, (sim, near) in best.items():
            real = sim > -1.5
            for place, x in enumerate((queries[m][0], near[real], sim[real], real.sum(1))):
                out[place].append(x)
        if out[0]:
            yield _emit(*out)

    return run


def usable_vectors(rows: DataFrame, key: str = "chunk_id", model: str = "embedding_model", vector: str = "embedding_vector", at: str = "embedded_at") -> DataFrame:
    """key, model, v: of each key the usable vector of the latest time; equal times: the greatest model and vector.

    Usable: the model isn't null and ends in the vector's length, no element is null or NaN, not all are zero.
    """
    v = F.col(vector)
    number = F.regexp_extract(F.col(model), r"(\d+)$", 1)
    good = (
        F.col(key).isNotNull() & F.col(model).isNotNull() & (number != "") & (F.try_to_number(number, F.lit("9999999999")) == F.size(v))
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    usable = rows.where(good).select(F.col(key).alias("key"), F.struct(F.col(at).alias("at"), F.col(model).alias("model"), v.cast("array<float>").alias("v")).alias("x"))
    return usable.groupBy("key").agg(F.max("x").alias("x")).select("key", "x.model", "x.v")


def nearest(vectors: DataFrame, k: int = 5, tables: int = TABLES, bucket: int = BUCKET, hot: int = HOT, whole: int = WHOLE) -> DataFrame:
    """key, other, similarity, rank: the k most similar vectors of the same model for every vector, by cosine.

    vectors: key (unique), model, v (finite, not all zero). Equal similarities are ranked by ``other``. A vector has
    fewer than k rows only if its model has at most k vectors. An empty table gives an empty result.

    The number of hashes follows the number of vectors, so buckets keep their size. Vectors of equal codes are copies
    and are searched for once. Buckets of more than ``hot`` members are compared in blocks, each with each other, so
    all that meet in a bucket are compared at any size, at quadratic cost; from ``whole`` members on the blocks grow with
    the bucket, so that a vector isn't sent to ever more of them. Vectors for which the tables give fewer than k others
    are looked up in wider buckets, and if that isn't enough compared with all, in blocks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbors")
    unit = vectors.select(F.col("key"), "model", "v").mapInArrow(_normalise, f"id {vectors.schema['key'].dataType.simpleString()}, model string, q binary")
    unit = scratch.cut(unit.withColumn("uid", F.monotonically_increasing_id()))
    found = {r.model: r for r in unit.groupBy("model").agg(F.count("*").alias("n"), F.max(F.octet_length("q") / 2).alias("d")).collect()}
    counts = {m: r.n for m, r in found.items()}

    def hashes(n: float, d: float) -> int:
        return max(1, math.ceil(math.log(max(2, n / bucket)) / math.log(2 << max(1, (int(d) - 1).bit_length())) - 0.05))

    numbers = {m: (i, hashes(counts[m], found[m].d)) for i, m in enumerate(sorted(counts))}
    same = [F.col("model"), F.xxhash64("q").alias("h"), F.xxhash64(F.lit(1), "q").alias("g")]
    copies = scratch.cut(unit.groupBy(*same).agg(F.count("*").alias("n"), F.min("uid").alias("rep")).where("n > 1").select("model", "h", "g", "rep"))
    copied = copies.limit(1).count() > 0
    index = unit
    if copied:
        members = scratch.cut(unit.select(*same, "uid", "id").join(copies, ["model", "h", "g"]).select("rep", "uid", "id"))
        index = scratch.cut(unit.join(members.where("uid <> rep").select("uid"), "uid", "left_anti"))
    small = index.select("uid", "model", "q")
    coded = scratch.cut(small.mapInArrow(_hasher(numbers, tables), _CODED))
    lists = scratch.cut(_merge(_meet(coded, k, hot, whole, scratch), k))
    left = index.groupBy("model").agg(F.least(F.lit(k), F.count("*") - 1).alias("want"))
    want = index.select("uid", "model").join(left, "model").select("uid", "want")
    short = scratch.cut(want.join(lists.select("uid", F.size("c").alias("n")), "uid", "left").where("coalesce(n, 0) < want").select("uid"))
    if short.limit(1).count():
        wider = {m: (i, h - 1) for m, (i, h) in numbers.items() if h > 1}
        if wider:
            wide = scratch.cut(small.where(F.col("model").isin(*wider)).mapInArrow(_hasher({m: wider.get(m, x) for m, x in numbers.items()}, tables), _CODED))
            asked = wide.join(short, "uid", "left_semi").select(F.explode(F.array_distinct("b")).alias("bucket")).distinct()
            near = wide.select("uid", "q", F.explode(F.array_distinct("b")).alias("bucket")).join(asked, "bucket", "left_semi")
            near = near.groupBy("uid", "q").agg(F.collect_list("bucket").alias("b"))
            more = _meet(scratch.cut(near), k, hot, whole, scratch).unionByName(lists)
            lists = scratch.cut(_merge(more, k))
            short = scratch.cut(want.join(lists.select("uid", F.size("c").alias("n")), "uid", "left").where("coalesce(n, 0) < want").select("uid"))
        if short.limit(1).count():
            lists = _complete(scratch, lists, short, index, numbers, k)
    pairs = lists.select("uid", F.explode("c").alias("c")).select("uid", "c.s", "c.b")
    if copied:
        own = members.select("rep").distinct().select(F.col("rep").alias("uid"), F.lit(1.0).cast("float").alias("s"), F.col("rep").alias("b"))
        ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
        few = ranked.select(F.col("rep").alias("b"), F.col("uid").alias("b_member"))
        pairs = pairs.unionByName(own).join(few, "b", "left").select("uid", "s", F.coalesce("b_member", "b").alias("b"))
        pairs = pairs.join(members.select(F.col("rep").alias("uid"), F.col("uid").alias("member")), "uid", "left")
        pairs = pairs.select(F.coalesce("member", "uid").alias("uid"), "s", "b").where("uid <> b")
    names = unit.select("uid", "id")
    out = pairs.join(names.select(F.col("uid").alias("b"), F.col("id").alias("other")), "b").join(names.select("uid", F.col("id").alias("key")), "uid")
    w = Window.partitionBy("key").orderBy(F.desc("s"), "other")
    return out.select("key", "other", F.col("s").cast("double").alias("similarity"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def _meet(coded: DataFrame, k: int, hot: int, whole: int, scratch: Scratch) -> DataFrame:
    """The best k of each vector in each bucket it stands in (uid, c); of crowded buckets with the same members one counts."""

    def compared(rows: DataFrame) -> DataFrame:
        return rows.select("bucket", "uid", "q").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_comparer(k), _FOUND)

    rows = coded.select(F.explode(F.array_distinct("b")).alias("bucket"), "uid", "q")
    h = F.xxhash64("uid")
    members = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"))
    large = scratch.cut(members.where(F.col("n") > hot))
    if not large.limit(1).count():
        return compared(rows)
    side = F.when(F.col("n") <= whole, F.lit(SIDE)).otherwise(F.greatest(F.lit(SIDE), F.least(F.lit(WIDEST), F.ceil(F.col("n") * SIDE / whole))))
    different = large.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / side).cast("int").alias("blocks"))
    blocks = rows.join(different, "bucket").withColumn("i", F.pmod(h, "blocks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    of = F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket")
    return compared(rows.join(large, "bucket", "left_anti")).unionByName(compared(blocks.select(of, "uid", "q")))


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Of all lists of a vector the k best different ones; each list has at most k entries, so few are gathered."""
    best = F.sort_array(F.flatten(F.collect_list("c")), asc=False)
    merged = found.groupBy("uid").agg(best.alias("c"))
    ids = F.slice(F.array_distinct(F.transform("c", lambda x: x["b"])), 1, k)
    return merged.select("uid", F.transform(ids, lambda b: F.filter("c", lambda x: x["b"] == b)[0]).alias("c"))


def _complete(scratch: Scratch, found: DataFrame, short: DataFrame, index: DataFrame, numbers: dict[str, tuple[int, int]], k: int) -> DataFrame:
    """Exact lists for the vectors in ``short``: each pass takes a bounded number of them against all vectors."""
    number = F.create_map(*[x for m, (i, _) in numbers.items() for x in (F.lit(m), F.lit(i))])
    rows = index.select(F.element_at(number, F.col("model")).cast("int").alias("model_no"), "uid", "q")
    todo = scratch.cut(rows.join(short, "uid", "left_semi"))
    out = found.join(short, "uid", "left_anti")
    passes = -(-todo.count() // QUERIES)
    for p in range(passes):
        queries: dict[int, tuple[list, list]] = {}
        for r in todo.where(F.pmod(F.xxhash64("uid"), F.lit(passes)) == p).toLocalIterator():
            ids, x = queries.setdefault(r.model_no, ([], []))
            ids.append(r.uid)
            x.append(bytes(r.q))
        arrays = {m: (np.asarray(i, np.int64), _decoded(pa.array(x, pa.binary()))) for m, (i, x) in queries.items()}
        out = out.unionByName(scratch.cut(_merge(rows.mapInArrow(_block_search(arrays, k), _FOUND), k)))
    return scratch.cut(out)
