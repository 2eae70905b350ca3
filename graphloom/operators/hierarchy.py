"""Parent-child links to full hierarchies: path, depth, root and number of descendants of every node; cycles found.

Nodes are laid out so that chains tend to stay together, and each partition follows parent links as far as they stay
inside it. A chain that leaves does so towards a node of another partition; only the nodes that are pointed at from
outside make up the smaller quotient forest, with links that lead from one of them to the next on its chain. The
quotient is solved the same way, recursively, and its solution is expanded inside the partitions. A node that nobody
outside points at never goes further than its own partition, however many children share one parent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import Scratch

#: Nodes of one partition, held in one task's memory, and nodes from which a forest is given to several.
ROWS_PER_PART, FEW = 60_000, 500
TREE, LOOP, BELOW = 0, 1, 2

#: A link leads from ``id`` to ``parent`` over w original links; lo is the least original id on it, its end left out.
#: Where it ends (parent is null), kind and root say how; size counts the original nodes that hang on ``id`` itself.
_NODE = "id string, parent string, w bigint, lo string, size bigint, kind int, root string, near string"
_SOLVED = "id string, kind int, root string, depth bigint, total bigint"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


class _Local:
    """A partition's forest. up: position of the parent or -1; order: leaves first, nodes on local rings left out."""

    def __init__(self, nodes: pd.DataFrame) -> None:
        self.ids, self.parents = nodes.id.tolist(), [None if p is None or p != p else p for p in nodes.parent]
        self.w, self.lo, self.kind, self.root = (nodes[c].tolist() for c in ("w", "lo", "kind", "root"))
        self.at = {x: i for i, x in enumerate(self.ids)}
        self.up = [self.at.get(p, -1) if p is not None else -1 for p in self.parents]
        self.n = len(self.ids)
        kids = [0] * self.n
        for u in self.up:
            if u >= 0:
                kids[u] += 1
        self.order = [i for i in range(self.n) if not kids[i]]
        for i in self.order:
            u = self.up[i]
            if u >= 0:
                kids[u] -= 1
                if not kids[u]:
                    self.order.append(u)
        self.rings: list[list[int]] = []
        for i in range(self.n):
            if kids[i] > 0:
                ring = []
                while kids[i] > 0:
                    kids[i] = 0
                    ring.append(i)
                    i = self.up[i]
                self.rings.append(ring)

    def totals(self, own: list[int]) -> list[int]:
        """Sums over the local subtrees; on a ring what hangs on each node of it."""
        total = list(own)
        for i in self.order:
            if self.up[i] >= 0:
                total[self.up[i]] += total[i]
        return total

    def ends(self) -> tuple[list, list, list, list, list]:
        """Of each node's chain: the outside node it leaves towards (or None), links up to its end, least id; else kind and root."""
        out, dist, low, kind, root = [None] * self.n, list(self.w), list(self.lo), list(self.kind), list(self.root)
        for ring in self.rings:
            least = min(self.lo[i] for i in ring)
            for i in ring:
                kind[i], root[i] = LOOP, least
        for i in reversed(self.order):
            u = self.up[i]
            if u < 0:
                out[i] = self.parents[i]
            else:
                out[i], dist[i], low[i] = out[u], self.w[i] + dist[u], min(self.lo[i], low[u])
                kind[i], root[i] = (TREE, root[u]) if kind[u] == TREE else (BELOW, root[u])
        return out, dist, low, kind, root


_CONTRACTED = f"part int, {_NODE}, out string, dist bigint, low string, end_kind int, end_root string, mass bigint"


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node with the end of its chain in this partition; mass: nodes that leave with it, at the last one before the end."""
    rows = pd.concat(list(batches), ignore_index=True)
    if len(rows):
        t = _Local(rows)
        out, dist, low, kind, root = t.ends()
        total = t.totals(rows["size"].tolist())
        mass = [total[i] if t.up[i] < 0 and t.parents[i] is not None else 0 for i in range(t.n)]
        rows = rows.assign(part=TaskContext.get().partitionId(), out=out, dist=dist, low=low, end_kind=kind, end_root=root, mass=mass)
        yield rows[[c.split()[0] for c in _CONTRACTED.split(", ")]]


def _expand(nodes: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """Solution of a partition's nodes from that of the outside nodes its chains lead to (what = 'out') and of its own nodes that are pointed at ('in')."""
    t = _Local(nodes)
    own, on_ring = nodes["size"].tolist(), bytearray(t.n)
    outside: dict[str, tuple[int, str, int]] = {}
    for what, node, kind, root, depth, total in zip(notes.what, notes.node, notes.kind, notes.root, notes.depth, notes.total, strict=True):
        if what == "out":
            outside[node] = int(kind), root, int(depth)
        else:
            own[t.at[node]] += int(total)
            on_ring[t.at[node]] = kind == LOOP
    total = t.totals(own)
    for i in t.order:
        if t.up[i] >= 0:
            on_ring[t.up[i]] |= on_ring[i]
    _, dist, _, kind, root = t.ends()
    depth = [0] * t.n
    for ring in t.rings:
        for i in ring:
            depth[i] = -1
    for i in reversed(t.order):
        u = t.up[i]
        if u >= 0:
            above, root[i], high = kind[u], root[u], depth[u]
        elif t.parents[i] is not None:
            above, root[i], high = outside[t.parents[i]]
        else:
            above, high = (TREE, 0) if kind[i] == TREE else (kind[i], 0)
        if above == TREE:
            kind[i], depth[i] = TREE, high + t.w[i]
        else:  # a ring through several partitions runs along this link, if a node that points here lies on it
            kind[i] = LOOP if on_ring[i] or (kind[i] == LOOP and t.parents[i] is None) else BELOW
            depth[i] = -1 if kind[i] == LOOP else -2
    return pd.DataFrame({"id": t.ids, "kind": kind, "root": root, "depth": depth, "total": total})


def _solve_here(nodes: pd.DataFrame) -> pd.DataFrame:
    return _expand(nodes, pd.DataFrame({c: [] for c in ("what", "node", "kind", "root", "depth", "total")}))


def _place(level: int) -> Column:
    """The node beside which a node is laid out: a third of all, drawn anew at each level, stay by themselves, the others go to their parent.

    Whether the parent has gone elsewhere isn't known here, so of a chain of scattered ids a quarter or so is joined
    at each level; leaves of a partition vanish from the quotient in any case.
    """
    stays = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(2)) == 0
    return F.when(F.col("parent").isNull() | stays("id") | ~stays("parent"), F.col("id")).otherwise(F.col("parent"))


def _solve(nodes: DataFrame, n: int, scratch: Scratch, rows_per_part: int, level: int = 0) -> DataFrame:
    """id, kind, root, depth, total of nodes (_NODE), of which every parent is a node too; totals are those of trees."""
    few = min(FEW, rows_per_part) if level == 0 else rows_per_part
    if n <= few:  # the last quotient
        return nodes.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_solve_here, _SOLVED)
    parts = max(-(-n // rows_per_part), min(scratch.spark.sparkContext.defaultParallelism, -(-n // few)))
    laid = nodes.withColumn("place", _place(level)).repartitionByRange(parts, "near", "place", "id")
    contracted = scratch.cut(laid.select(_COLUMNS).mapInPandas(_contract, _CONTRACTED))
    pointed = contracted.where("mass > 0").groupBy("parent").agg(F.sum("mass").alias("hung")).withColumnRenamed("parent", "target")
    quotient = scratch.cut(
        contracted.join(pointed, F.col("id") == F.col("target")).selectExpr(
            "id", "out as parent", "dist as w", "low as lo", "hung as size", f"if(out is null, end_kind, {TREE}) as kind", "if(out is null, end_root, id) as root", "near", "part",
        )
    )
    solved = scratch.cut(_solve(quotient.select(_COLUMNS), quotient.count(), scratch, rows_per_part, level + 1))
    leaving = contracted.where("mass > 0").select("part", F.col("parent").alias("id")).distinct().join(solved, "id").withColumn("what", F.lit("out"))
    entered = quotient.select("part", "id").join(solved, "id").withColumn("what", F.lit("in"))
    notes = leaving.unionByName(entered).select(F.col("part").alias("of"), "what", F.col("id").alias("node"), "kind", "root", "depth", "total")
    return contracted.select("part", *_COLUMNS).groupBy("part").cogroup(notes.groupBy("of")).applyInPandas(lambda a, b: _expand(a, b), _SOLVED)


def latest_pages(rows: DataFrame, node: str, parent: str, version: str, near: str | None = None) -> DataFrame:
    """node, parent, near of each node's row with the highest version; equal versions: the greatest parent counts."""
    cols = [F.col(version).alias("v"), F.trim(F.col(parent), F.lit(" \t\r\n")).alias("parent")]
    cols.append((F.col(near) if near else F.lit(None)).cast("string").alias("near"))
    best = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.max(F.struct(*cols)).alias("x"))
    return best.select("id", "x.parent", "x.near")


def hierarchy(links: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """document_id, root_id, tree_depth (int), n_descendants (bigint): one row for each distinct ``id`` of ``links``.

    links: id, parent, near (``near``: a column whose equal values are often in one tree; may be null). Ids are unique
    and not null. A null, blank or unknown parent makes a root. On a loop tree_depth is -1, beneath a loop -2, and
    root_id is then the loop's smallest id. n_descendants counts the other nodes reached downwards.
    An empty table gives an empty result.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    known = links.select(F.col("id").alias("pid"))
    nodes = scratch.cut(
        links.join(known, F.col("parent") == F.col("pid"), "left").selectExpr(
            "id", "pid as parent", "cast(if(pid is null, 0, 1) as bigint) as w", "id as lo", "cast(1 as bigint) as size", f"{TREE} as kind", "id as root", "coalesce(near, '') as near",
        )
    )
    solved = scratch.cut(_solve(nodes, nodes.count(), scratch, rows_per_part))
    # every page of a loop has all others of the loop and all that lies beneath it
    whole = solved.where(f"kind <> {TREE}").groupBy("root").agg(F.count("*").alias("whole"))
    loops = solved.where(f"kind = {LOOP}").join(whole, "root").selectExpr("id", "root", "depth", "whole as total")
    out = solved.where(f"kind <> {LOOP}").select("id", "root", "depth", "total").unionByName(loops)
    return out.selectExpr("id as document_id", "root as root_id", "cast(depth as int) as tree_depth", "cast(total - 1 as bigint) as n_descendants")


def paths(links: DataFrame, solved: DataFrame, sep: str = " > ", max_rounds: int = 64) -> DataFrame:
    """document_id, path: ids from the root, or from the loop's smallest id, down to the node.

    Doubling over paths: round k joins the path of the node 2**k above, so a tree of depth d takes log2(d) joins.
    Nodes on a loop have their own id as path, nodes beneath one the way from the loop.
    """
    scratch = Scratch(links.sparkSession, "paths")
    on = solved.select(F.col("document_id").alias("id"), "tree_depth")
    known = on.select(F.col("id").alias("pid"))
    cur = scratch.cut(
        links.join(on, "id").join(known, F.col("parent") == F.col("pid"), "left")
        .selectExpr("id", "if(tree_depth = -1, null, pid) as up", "id as path")
    )
    for _ in range(max_rounds):
        if not cur.where("up is not null").limit(1).count():
            break
        above = cur.selectExpr("id as up", "up as next", "path as head")
        new = scratch.cut(cur.join(above, "up", "left").select("id", F.col("next").alias("up"), F.concat_ws(sep, "head", "path").alias("path")))
        scratch.drop(cur)
        cur = new
    return cur.selectExpr("id as document_id", "path")


def all_descendants(links: DataFrame, solved: DataFrame, max_rounds: int = 64) -> DataFrame:
    """document_id, descendant_id, levels: every pair of a node and another that is reached from it downwards.

    Pages of a loop are beneath one another, and what lies beneath a loop is so for each of its pages; levels is the
    least number of links. Doubling over arrays of ids, as in ``paths``; a loop is cut above its smallest id, and the
    pages that this leaves out of an array are added. So many rows for each node as hierarchy() has for n_descendants.
    """
    scratch = Scratch(links.sparkSession, "descendants")
    on = solved.select(F.col("document_id").alias("id"), "root_id", "tree_depth")
    known = on.select(F.col("id").alias("pid"))
    cur = scratch.cut(
        links.select("id", "parent").join(on, "id").join(known, F.col("parent") == F.col("pid"), "left")
        .selectExpr("id", "root_id", "tree_depth", "if(tree_depth = -1 and id = root_id, null, pid) as up", "array(id) as way")
    )
    for _ in range(max_rounds):
        if not cur.where("up is not null").limit(1).count():
            break
        above = cur.selectExpr("id as up", "up as next", "way as head")
        new = cur.join(above, "up", "left").selectExpr("id", "root_id", "tree_depth", "next as up", "if(head is null, way, concat(head, way)) as way")
        new = scratch.cut(new)
        scratch.drop(cur)
        cur = new
    upwards = cur.select(F.posexplode("way").alias("i", "document_id"), F.col("id").alias("descendant_id"), F.size("way").alias("n")).where("i < n - 1")
    loop = cur.where("tree_depth = -1").selectExpr("root_id", "id as document_id", "size(way) - 1 as place")
    loop = loop.join(loop.groupBy("root_id").agg(F.count("*").cast("int").alias("length")), "root_id")
    round_ = cur.where("tree_depth < 0").select("root_id", F.col("id").alias("descendant_id"), "way").join(loop, "root_id").where("not array_contains(way, document_id)")
    return upwards.selectExpr("document_id", "descendant_id", "n - 1 - i as levels").unionByName(
        round_.selectExpr("document_id", "descendant_id", "length + size(way) - 1 - place as levels")
    )
