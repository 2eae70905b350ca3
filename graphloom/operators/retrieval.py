"""Retrieval: vector top-k, mentioned entities, bounded expansion along trails, and the context built from them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.scratch import Scratch

MAX_HOPS, MAX_LIMIT, MAX_QUERY = 3, 100, 4000
#: Directed edges that a task holds to walk along, and rows of a batch that it gives.
WALKED, GIVEN = 3 << 20, 1 << 15
# The texts of the context.
NOTHING = "No approved knowledge graph content was found for this query."
EXCERPTS = "Relevant excerpts from approved documents:"
FENCE = "<<<BEGIN_UNTRUSTED_DOCUMENT_EXCERPT>>>{}<<<END_UNTRUSTED_DOCUMENT_EXCERPT>>>"
ENTITIES = "Related entities mentioned:"
PATHS = "Relationships between these entities:"
STEPS = "Next steps in this process:"


def clamp(hops: int, limit: int) -> tuple[int, int]:
    """Q5: hops within 1 and 3, limit within 1 and 100."""
    return max(1, min(int(hops), MAX_HOPS)), max(1, min(int(limit), MAX_LIMIT))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine of a vector column and a query; null where lengths differ or either has no length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when(F.size(v) == len(query), F.try_divide(dot, norm * F.lit(length)))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "embedding_vector") -> DataFrame:
    """Key, similarity, score = (1 + similarity) / 2 of the k most similar vectors, exactly; equal ones by key.

    One pass: the query is a literal, each partition keeps its k best, so nothing but those is moved.
    """
    scored = vectors.select(key, cosine(F.col(vector), query).alias("similarity")).where("similarity is not null and not isnan(similarity)")
    return scored.orderBy(F.desc("similarity"), key).limit(k).withColumn("score", (F.col("similarity") + 1) / 2)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding_vector", per_pass: int = 1024) -> DataFrame:
    """Q1 for many queries: query, key, similarity, score; exactly, equal ones by key. queries: query (of the key's type), v.

    Each pass takes some ``per_pass`` queries against all vectors; each batch keeps what can be among a query's k best.
    """
    kind = vectors.schema[key].dataType.simpleString()
    passes, out = -(-queries.count() // per_pass), None

    def search(ids: list, rows: list):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            length = np.array([len(r) for r in rows])
            for b in batches:
                keep = b[[x is not None for x in b.v]]
                sizes = keep.v.map(len).to_numpy(dtype=np.int64)
                for d in np.intersect1d(length, sizes):
                    x = np.stack(keep.v[sizes == d].to_numpy()).astype(float)
                    norm, q = np.linalg.norm(x, axis=1), np.stack([np.asarray(rows[i], float) for i in np.flatnonzero(length == d)])
                    good = norm > 0
                    if not good.any():
                        continue
                    keys = keep.key.to_numpy()[sizes == d][good]
                    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x[good] / norm[good, None]).T
                    s[np.isnan(s)] = -np.inf
                    least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                    i, j = np.nonzero((s >= least[:, None] - 1e-12) & (s > -np.inf))  # equal ones all stay
                    at = np.flatnonzero(length == d)
                    yield pd.DataFrame({"query": [ids[z] for z in at[i]], "key": keys[j], "similarity": s[i, j]})

        return run

    for p in range(passes):
        found = queries.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p).where("exists(v, x -> x <> 0)").collect()
        part = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInPandas(search([r.query for r in found], [r.v for r in found]), f"query {kind}, key {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], f"query {kind}, key {kind}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    best = out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return best.select("query", F.col("key").alias(key), "similarity", ((F.col("similarity") + 1) / 2).alias("score"))


def mentioned_each(mentions: DataFrame, ents: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Q2 for each chunk apart: chunk_id, entity_id, name, entity_type."""
    hit = mentions.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "entity_id").distinct()
    return hit.join(ents, hit["entity_id"] == ents["id"]).select("chunk_id", "entity_id", "name", F.col("type").alias("entity_type"))


def mentioned(mentions: DataFrame, ents: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Q2: entity_id, name, entity_type of the entities mentioned in the chunks (chunk_id)."""
    hit = mentions.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("entity_id").distinct()
    return hit.join(ents, hit["entity_id"] == ents["id"]).select("entity_id", "name", F.col("type").alias("entity_type"))


def trails(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """source_id, target_id, labels (array): all trails of 1 to ``hops`` edges from the seeds (id), no edge twice in one.

    edges: a, b, label. Ends that are seeds are left out; equal (source, target, labels) are one row. Each hop is an
    equi-join on the current node, so a hub's rows can be split like those of any skewed join.
    """
    start = seeds.select(F.col("id").alias("source_id")).distinct()
    ended = _walks(edges, start, hops, directed).join(start.withColumnRenamed("source_id", "at"), "at", "left_anti")
    return ended.select("source_id", F.col("at").alias("target_id"), "labels").distinct()


def _walks(edges: DataFrame, start: DataFrame, hops: int, directed: bool) -> DataFrame:
    """source_id, at, labels, used: the trails from ``start`` (source_id), wherever they end."""
    steps = _steps(edges, directed)
    front = start.join(steps, F.col("source_id") == F.col("a")).select("source_id", F.col("b").alias("at"), F.array("label").alias("labels"), F.array("edge").alias("used"))
    out = front
    for _ in range(hops - 1):
        front = (
            front.join(steps, F.col("at") == F.col("a")).where(~F.array_contains("used", F.col("edge")))
            .select("source_id", F.col("b").alias("at"), F.array_append("labels", F.col("label")).alias("labels"), F.array_append("used", F.col("edge")).alias("used"))
        )
        out = out.unionByName(front)
    return out


def _found_each(steps: DataFrame, seeds: DataFrame, ends: DataFrame, hops: int, limit: int, order: list, scratch: Scratch) -> DataFrame:
    """query, source_name, id, name, labels: for each query its first ``limit`` ends of trails, shortest first, then by ``order``.

    steps: a, b, label, edge (a trail takes an edge once); seeds: query, id; ends: id, name. ``order`` starts with
    source_name and id. Of equal length and start a trail's place follows from its last node, so of a node's last
    steps only as many count as there are results, seeds and edges taken before; queries with enough results don't go
    further. So a hub costs a query no more than another node, except as a seed, which fills a query at the first hop.
    """
    seeds = scratch.cut(seeds.select("query", F.col("id").alias("source_id")).distinct().join(ends.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id"))
    most = seeds.groupBy("query").count().agg(F.max("count")).first()[0]
    if most is None:
        none = "query string, source_name string, id string, name string, labels array<string>"
        return seeds.sparkSession.createDataFrame([], none)
    steps = scratch.cut(steps)
    # equal edges count once; of those that a trail may have taken before, one more is kept for each hop
    same = Window.partitionBy("a", "b", "label").orderBy("edge")
    last = steps.withColumn("m", F.row_number().over(same)).where(F.col("m") <= hops).join(ends.select(F.col("id").alias("b"), "name"), "b")
    last = last.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b", "label", "edge"))).where(F.col("n") <= (limit + most + hops) * hops)
    last = scratch.cut(last.select("a", "b", "label", "edge", "name"))
    front = seeds.select("query", "source_id", "source_name", F.col("source_id").alias("at"), F.array().cast("array<string>").alias("labels"), F.array().cast(f"array<{steps.schema['edge'].dataType.simpleString()}>").alias("used"))
    out = None
    for hop in range(hops):
        ended = front.join(last, F.col("at") == F.col("a")).where(~F.array_contains("used", F.col("edge")))
        ended = ended.select("query", "source_name", F.col("b").alias("id"), "name", F.array_append("labels", F.col("label")).alias("labels"))
        ended = ended.join(seeds.select("query", F.col("source_id").alias("id")), ["query", "id"], "left_anti").distinct()
        w = Window.partitionBy("query").orderBy(F.size("labels"), *order)
        both = ended if out is None else out.unionByName(ended)
        out = scratch.cut(both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n"))
        if hop + 1 < hops:
            full = out.groupBy("query").count().where(F.col("count") >= limit).select("query")
            front = front.join(full, "query", "left_anti").join(steps, F.col("at") == F.col("a")).where(~F.array_contains("used", F.col("edge")))
            front = scratch.cut(front.select("query", "source_id", "source_name", F.col("b").alias("at"), F.array_append("labels", F.col("label")).alias("labels"), F.array_append("used", F.col("edge")).alias("used")))
    return out


def _steps(edges: DataFrame, directed: bool) -> DataFrame:
    """a, b, label, edge of edges (a, b, label), in both directions unless directed; equal edges have numbers of their own."""
    numbered = edges.select("a", "b", "label").where("a is not null and b is not null").withColumn("edge", F.xxhash64("a", "b", "label"))
    numbered = numbered.withColumn("edge", F.struct("edge", F.row_number().over(Window.partitionBy("a", "b", "label").orderBy("edge"))))
    return numbered if directed else numbered.unionByName(numbered.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "label", "edge"))


def neighbors_each(ents: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1, limit: int = 20) -> DataFrame:
    """Q3 for each query apart: query and the columns of ``neighbors``, ``limit`` of them a query. seeds: query, id."""
    hops, limit = clamp(hops, limit)
    steps = _steps(edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("relationship").alias("label")), False)
    found = _found_each(steps, seeds, ents.select("id", "name"), hops, limit, ["source_name", "id", "labels"], Scratch(ents.sparkSession, "neighbors"))
    of = found.join(ents.select("id", F.col("type").alias("entity_type")), "id")
    return of.select("query", F.col("id").alias("entity_id"), "name", "entity_type", "source_name", F.col("labels").alias("relationship_types")).distinct()


def linked_documents_each(docs: DataFrame, links: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 20) -> DataFrame:
    """Q4 for each query apart: query and the columns of ``linked_documents``, ``limit`` of them a query. seeds: query, id."""
    hops, limit = clamp(hops, limit)
    steps = _steps(links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("answer_label").alias("label")), True)
    found = _found_each(steps, seeds, docs.select("id", "name"), hops, limit, ["source_name", "id", "labels"], Scratch(docs.sparkSession, "linked"))
    return found.select("query", F.col("id").alias("document_id"), "name", "source_name", F.col("labels").alias("answer_labels")).distinct()


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers, compressed."""
    return zlib.compress(np.diff(numbers, prepend=0).astype("<i8").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<i8"))


class _Walked:
    """Edges into a part of the nodes, by their starts; nodes have places in the order of their numbers."""

    def __init__(self, nodes: list[pa.RecordBatch], steps: list[pa.RecordBatch]) -> None:
        at, names = (pa.chunked_array([b.column(c) for b in nodes]) for c in ("at", "name"))
        order = np.argsort(at.to_numpy())
        self.numbers, self.names = at.to_numpy()[order], names.combine_chunks().take(pa.array(order))
        start, end = (np.searchsorted(self.numbers, np.concatenate([b.column(c).to_numpy() for b in steps])).astype(np.int32) for c in ("at", "to"))
        order = np.argsort(start, kind="stable")
        self.start, self.end = start[order], end[order]
        self.label = pa.chunked_array([b.column("label") for b in steps]).combine_chunks().dictionary_encode().take(pa.array(order))
        self.first = np.searchsorted(self.start, np.arange(len(self.numbers) + 1))

    def places(self, numbers: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        return np.unique(place[self.numbers[place] == numbers])

    def reached(self, front: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes beside the front that aren't seen, and of each the edge from the least node of the front."""
        n = self.first[front + 1] - self.first[front]
        edge = np.repeat(self.first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
        by = np.full(len(self.numbers), -1, np.int64)
        by[self.end[edge][::-1]] = edge[::-1]  # the last that is written is the first
        new = np.flatnonzero((by >= 0) & ~seen)
        return new, by[new]


def _walk(hops: range, given: bool):
    """Rows of ``breadth_first_each`` of the hops, or (not given) query and numbers of the nodes of the only one.

    Rows come in runs of a slot: nodes (kind 0), steps (1), queries (2) with the nodes found at each hop before.
    """

    def walked(edges: _Walked, row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        query, seeds, fronts = row.column("query"), row.column("seeds")[0].as_py(), row.column("fronts")[0].as_py()
        found = [edges.places(np.asarray(seeds, np.int64)), *(edges.places(np.concatenate([_unpacked(x) for x in f])) for f in fronts)]
        seen = np.zeros(len(edges.numbers), bool)
        for f in found:
            seen[f] = True
        front = found[-1]
        for hop in hops:
            front, edge = edges.reached(front, seen)
            seen[front] = True
            if not given and len(front):
                yield pa.RecordBatch.from_arrays([query, pa.array([_packed(edges.numbers[front])])], names=["query", "found"])
            for k in range(0, len(front) if given else 0, GIVEN):
                to, by = front[k : k + GIVEN], edge[k : k + GIVEN]
                columns = [edges.names.take(pa.array(to)), edges.names.take(pa.array(edges.start[by])), edges.label.take(pa.array(by)).dictionary_decode()]
                yield pa.RecordBatch.from_arrays(
                    [query.take(pa.array(np.zeros(len(to), np.int32))), *columns, pa.array(np.full(len(to), hop, np.int32))], names=["query", "target_id", "source_id", "label", "hop"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, edges = None, ([], []), None
        for batch in batches:
            slot, kind = (batch.column(c).to_numpy() for c in ("slot", "kind"))
            cut = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(slot) else np.zeros(1, int)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if slot[a] != last:
                    last, parts, edges = slot[a], ([], []), None
                if kind[a] < 2:
                    parts[kind[a]].append(batch.select(["at", "name"] if kind[a] == 0 else ["at", "to", "label"]).slice(a, b - a))
                    continue
                if edges is None and parts[1]:
                    edges, parts = _Walked(*parts), ([], [])
                for k in range(a, b if edges is not None else a):
                    yield from walked(edges, batch.slice(k, 1))

    return run


def breadth_first_each(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False, walked: int = WALKED) -> DataFrame:
    """Q7 for each query apart: query and the columns of ``breadth_first``. edges: a, b, label; seeds: query, id.

    Edges with a null end lead nowhere. Queries may reach nearly all nodes each, so what they find is neither shuffled
    nor written before it is returned: nodes become numbers in their order, a task holds the edges into some of them,
    ``walked`` at most (besides those into one node), and takes its queries one by one. If there are more edges than
    that, the nodes found on the way move between hops as compressed numbers.
    """
    hops, _ = clamp(hops, 1)
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession, "breadth")
    e = edges.select("a", "b", "label").where("a is not null and b is not null and a <> b")
    steps = e if directed else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "label"))
    steps = scratch.cut(steps.groupBy("a", "b").agg(F.min(F.struct("label")).alias("x")).select("a", "b", "x.label"))
    nodes = steps.select(F.explode(F.array("a", "b")).alias("id")).distinct().orderBy("id").withColumn("n", F.monotonically_increasing_id())
    nodes = scratch.cut(nodes)
    numbered = steps.join(nodes.select(F.col("id").alias("a"), F.col("n").alias("at")), "a").join(nodes.select(F.col("id").alias("b"), F.col("n").alias("to")), "b")
    blocks = max(1, -(-steps.count() // walked))
    shards = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    steps = scratch.cut(numbered.select(F.pmod(F.xxhash64("to"), F.lit(blocks)).cast("int").alias("block"), "at", "to", "label"))
    ends = steps.select("block", F.explode(F.array("at", "to")).alias("at")).distinct().join(nodes.select(F.col("n").alias("at"), F.col("id").alias("name")), "at")
    asked = seeds.select("query", "id").join(nodes, "id").groupBy("query").agg(F.collect_set("n").alias("seeds"))
    asked = scratch.cut(asked.withColumn("fronts", F.array().cast("array<array<binary>>")))
    kind, of, label = (df.schema[c].dataType.simpleString() for df, c in ((seeds, "query"), (nodes, "id"), (steps, "label")))

    def found(asked: DataFrame, over: range, given: bool) -> DataFrame:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        shard = F.pmod(F.xxhash64("query"), F.lit(shards)).cast("int")
        rows = ends.withColumn("shard", every(shards)).withColumn("kind", F.lit(0))
        rows = rows.unionByName(steps.withColumn("shard", every(shards)).withColumn("kind", F.lit(1)), allowMissingColumns=True)
        rows = rows.unionByName(asked.withColumn("block", every(blocks)).withColumn("shard", shard).withColumn("kind", F.lit(2)), allowMissingColumns=True)
        rows = rows.withColumn("slot", F.col("block") * shards + F.col("shard")).drop("block", "shard")
        rows = rows.repartitionById(blocks * shards, F.col("slot")).sortWithinPartitions("slot", "kind")
        return rows.mapInArrow(_walk(over, given), f"query {kind}, target_id {of}, source_id {of}, label {label}, hop int" if given else f"query {kind}, found binary")

    if blocks == 1:
        return found(asked, range(1, hops + 1), True)
    out = found(asked, range(1, 2), True)
    for hop in range(1, hops):
        new = found(asked, range(hop, hop + 1), False).groupBy("query").agg(F.collect_list("found").alias("new"))
        asked = scratch.cut(asked.join(new, "query").select("query", "seeds", F.array_append("fronts", F.col("new")).alias("fronts")))
        out = out.unionByName(found(asked, range(hop + 1, hop + 2), True))
    return out


def neighbors(ents: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1, limit: int = 20) -> DataFrame:
    """Q3: entity_id, name, entity_type, source_name, relationship_types of paths of up to ``hops`` undirected edges.

    Paths come in order of length, ids and types, ``limit`` of them. edges: source, relationship, target; to expand
    along mentions too, give those as edges of their own type. Only entities end a path.
    """
    hops, limit = clamp(hops, limit)
    t = trails(edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("relationship").alias("label")), seeds, hops)
    source = ents.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    target = ents.select(F.col("id").alias("target_id"), "name", F.col("type").alias("entity_type"))
    rows = t.join(source, "source_id").join(target, "target_id")
    rows = rows.select(F.col("target_id").alias("entity_id"), "name", "entity_type", "source_name", F.col("labels").alias("relationship_types")).distinct()
    return rows.orderBy(F.size("relationship_types"), "source_name", "entity_id", "relationship_types").limit(limit)


def co_mention_edges(mentions: DataFrame) -> DataFrame:
    """Q3, ``edge_scope='all'``: mentions as edges, so that two hops reach what is mentioned in the same chunk."""
    return mentions.select(F.col("chunk_id").alias("source"), F.lit("MENTIONS").alias("relationship"), F.col("entity_id").alias("target"))


def linked_documents(docs: DataFrame, links: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 20) -> DataFrame:
    """Q4: document_id, name, source_name, answer_labels of paths of up to ``hops`` links, followed forward only."""
    hops, limit = clamp(hops, limit)
    t = trails(links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("answer_label").alias("label")), seeds, hops, directed=True)
    source = docs.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    rows = t.join(source, "source_id").join(docs.select(F.col("id").alias("target_id"), "name"), "target_id")
    rows = rows.select(F.col("target_id").alias("document_id"), "name", "source_name", F.col("labels").alias("answer_labels")).distinct()
    return rows.orderBy(F.size("answer_labels"), "source_name", "document_id", "answer_labels").limit(limit)


def breadth_first(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """Q7: target_id, source_id, label, hop: each node once, with the least edge of the first hop that reaches it."""
    hops, _ = clamp(hops, 1)
    e = edges.select("a", "b", "label")
    steps = e if directed else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "label"))
    front = seeds.select("id").distinct()
    visited, out = front, None
    for hop in range(1, hops + 1):
        new = front.join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.col("a").alias("source_id"), "label").join(visited, "id", "left_anti")
        new = new.groupBy("id").agg(F.min(F.struct("source_id", "label")).alias("x")).select("id", "x.source_id", "x.label")
        found = new.select(F.col("id").alias("target_id"), "source_id", "label", F.lit(hop).alias("hop"))
        out = found if out is None else out.unionByName(found)
        front = new.select("id")
        visited = visited.unionByName(front)
    return out


def path_text(source: Column, types: Column, target: Column) -> Column:
    """Q10: ``A T1 -> T2 B``."""
    between = F.coalesce(F.nullif(F.array_join(types, " -> "), F.lit("")), F.lit("related to"))
    return F.concat_ws(" ", source, between, target)


def next_step_text(source: Column, labels: Column, target: Column) -> Column:
    """Q10: ``If l1 -> l2: see X``, or ``A leads to X`` without a label."""
    said = F.array_join(F.filter(labels, lambda x: x != ""), " -> ")
    return F.when(said != "", F.concat(F.lit("If "), said, F.lit(": see "), target)).otherwise(F.concat(source, F.lit(" leads to "), target))


def query_graph(spark: SparkSession, tables: dict[str, DataFrame], sql: str, args: dict[str, object] | None = None) -> DataFrame:
    """Q6: a read-only SQL query with named parameters over the graph's tables, registered as views for it."""
    if not sql.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only queries that read are allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})


@dataclass
class Context:
    """Q9: what is found for a question."""

    chunks: list[dict] = field(default_factory=list)
    entities: list[dict] = field(default_factory=list)
    graph_paths: list[str] = field(default_factory=list)
    citations: list[dict] = field(default_factory=list)
    next_steps: list[str] = field(default_factory=list)


def check_question(question: str) -> str:
    """Q12: the question stripped; ValueError if it is blank or too long."""
    if not question.strip():
        raise ValueError("the question is empty")
    if len(question) > MAX_QUERY:
        raise ValueError(f"the question is longer than {MAX_QUERY} characters")
    return question.strip()


def retrieve(
    question: str, embed: Callable[[str], list[float]], chunks: DataFrame, vectors: DataFrame, ents: DataFrame, mentions: DataFrame, edges: DataFrame,
    docs: DataFrame, links: DataFrame, top: int = 8, hops: int = 1, limit: int = 20, link_hops: int = 2,
) -> Context:
    """Q8, Q9: nearest chunks, their entities and these entities' neighbours, and what the chunks' documents lead to.

    chunks: id, document, content. What is collected is bounded by ``top`` and the limits.
    """
    spark = chunks.sparkSession
    best = top_k(vectors, embed(check_question(question)), top)
    found = chunks.join(F.broadcast(best), chunks["id"] == best["chunk_id"]).select("chunk_id", "content", F.col("document").alias("document_id"), "score")
    rows = [r.asDict() for r in found.orderBy(F.desc("score"), "chunk_id").collect()]
    if not rows:
        return Context()
    named = [r.asDict() for r in mentioned(mentions, ents, spark.createDataFrame([(r["chunk_id"],) for r in rows], "chunk_id string")).orderBy("entity_id").collect()]
    paths: list[str] = []
    if named:
        seeds = spark.createDataFrame([(r["entity_id"],) for r in named], "id string")
        near = neighbors(ents, edges, seeds, hops, limit).withColumn("text", path_text(F.col("source_name"), F.col("relationship_types"), F.col("name"))).collect()
        paths = [r.text for r in near]
        named += list({r.entity_id: {"entity_id": r.entity_id, "name": r.name, "entity_type": r.entity_type} for r in near}.values())
    seeds = spark.createDataFrame([(d,) for d in sorted({r["document_id"] for r in rows})], "id string")
    led = linked_documents(docs, links, seeds, link_hops, limit).select(next_step_text(F.col("source_name"), F.col("answer_labels"), F.col("name")).alias("t"))
    return Context(rows, named, paths, [{k: r[k] for k in ("chunk_id", "document_id")} for r in rows], [r.t for r in led.collect()])


def context_text(context: Context) -> str:
    """Q11: the context as text for a model; excerpts are fenced as untrusted."""
    if not context.chunks:
        return NOTHING
    out = [EXCERPTS]
    out += [f"- (chunk {c['chunk_id']} from document {c['document_id']}): {FENCE.format(c['content'])}" for c in context.chunks]
    sections = (
        (ENTITIES, [f"{e['name']} ({e['entity_type']})" for e in context.entities]),
        (PATHS, context.graph_paths),
        (STEPS, context.next_steps),
    )
    for title, rows in sections:
        if rows:
            out += [f"\n{title}", *(f"- {r}" for r in rows)]
    return "\n".join(out)
