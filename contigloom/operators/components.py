"""Connected components and chain ranking on edge tables.

Partitions of neighbouring numbers first settle what lies inside them; what
is left is a smaller graph (or list) of the places where partitions meet, which
is settled the same way.  Where that no longer shrinks, rounds of joins halve
the rest, each round stored, so neither depends on the diameter of the graph.
Tables that grow with the graph meet by shuffles (the merge hints).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigloom.session import cut_lineage

# Fixed value: a next graph or list larger than this part of the one before is left to rounds of joins.
SHRINKS = 0.8


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join each vertex of a partition to the smallest vertex it is linked to there."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while parent[top] != top:
            top = parent[top]
        while parent[v] != top:
            parent[v], v = top, parent[v]
        return top

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(v, root(v)) for v in parent]
    for at in range(0, len(pairs), 65536):
        yield pd.DataFrame(pairs[at : at + 65536], columns=["u", "v"])


def _star(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step over edges (u, v): link neighbours of u to its smallest neighbour.

    The large star links the neighbours above u, the small star those below.
    The smallest neighbour comes from an aggregate, so a hub is combined before
    the shuffle and AQE may split the join on it.
    """
    both = edges.where("u <> v").select("u", "v")
    if keep_larger:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(low.hint("merge"), "u")
    if keep_larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def _unfinished(stars: DataFrame) -> bool:
    """Some vertex has two parents, or is both child and parent."""
    links = stars.where("u <> v")
    roles = links.select(F.col("u").alias("x"), "v", F.lit(0).alias("is_parent")).unionByName(
        links.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v"), F.lit(1).alias("is_parent"))
    )
    state = roles.groupBy("x").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("is_parent").alias("is_parent")
    )
    return bool(state.where("lo IS NOT NULL AND (lo <> hi OR is_parent = 1)").limit(1).count())


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): component is the smallest vertex of each.

    ``edges`` holds long columns u, v; give them with the end whose numbers follow
    the graph first.  Ranges of edges are reduced to forests, and the roots that
    share a vertex are the edges of the next, smaller graph.  Where a graph
    stays large, its stars alternate until nothing changes.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).distinct()
    levels, size = [], None
    while True:
        # by both ends, so that a hub is spread
        roots = edges.repartitionByRange("u", "v").mapInPandas(_local_forest, "u long, v long")
        # a vertex has one root in each range it is seen in, so the lists stay short
        found = roots.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("root"), F.collect_set("v").alias("met"))
        level = cut_lineage(found.select("vertex", "root", F.when(F.size("met") > 1, F.col("met")).alias("met")))
        levels.append(level.select("vertex", "root"))
        links = level.where("met IS NOT NULL").select(F.explode("met").alias("u"), F.col("root").alias("v"))
        edges = cut_lineage(links.where("u <> v").distinct())
        before, size = size, edges.count()
        if not size:
            labels = None
            break
        if before is not None and size > SHRINKS * before:
            labels = _star_components(edges)
            break
    for level in reversed(levels):
        if labels is None:
            labels = level.withColumnRenamed("root", "component")
            continue
        above = labels.select(F.col("vertex").alias("root"), "component")
        joined = level.join(above.hint("merge"), "root", "left").select("vertex", F.coalesce("component", "root").alias("component"))
        labels = joined if level is levels[0] else cut_lineage(joined)
    return labels


def _star_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) by large and small stars in turn."""
    stars = edges
    while _unfinished(stars):
        stars = cut_lineage(_star(_star(stars, True), False))
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias("component")).distinct()


def _local_jumps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow the pointers that stay inside one partition to where they leave it."""
    jump: dict[int, int | None] = {}
    rank: dict[int, int] = {}
    head: dict[int, int] = {}
    for pdf in batches:
        for node, to, steps, end in zip(pdf["node"].tolist(), pdf["jump"].tolist(), pdf["rank"].tolist(), pdf["head"].tolist()):
            jump[node] = None if pd.isna(to) else int(to)
            rank[node] = steps
            if jump[node] is None:
                head[node] = int(end)
    settled: dict[int, int] = {}  # node -> the head it ends at, or -1 while it leaves the partition
    lost: set[int] = set()
    for start in jump:
        walk, seen, at = [], set(), start
        while at not in settled and at not in lost and at not in seen:
            seen.add(at)
            walk.append(at)
            nxt = jump[at]
            if nxt is None or nxt not in jump:
                settled[at] = head[at] if nxt is None else -1
                walk.pop()
                break
            at = nxt
        if at in lost or at in seen and at not in settled:
            lost.update(walk)  # leads into a cycle
            continue
        for node in reversed(walk):
            after = jump[node]
            rank[node] += rank[after]
            settled[node] = settled[after]
            jump[node] = jump[after]
    rows = [
        (node, jump[node], rank[node], settled[node] if jump[node] is None else None)
        for node in jump
        if node not in lost
    ]
    for at in range(0, len(rows), 65536):
        part = pd.DataFrame(rows[at : at + 65536], columns=["node", "jump", "rank", "head"])
        yield part.astype({"jump": "Int64", "head": "Int64"})


_STATE = "node long, jump long, rank long, head long"


def rank_chains(nodes: DataFrame, *near: str) -> DataFrame:
    """Rank list nodes: (node, prev) to (node, head, rank).

    ``prev`` is NULL at the head of a list.  Partitions of neighbouring numbers
    (or of the columns ``near``, where numbers do not follow the lists) resolve
    their own pointers; the nodes that are pointed at from outside are a shorter
    list, ranked first.  Nodes on a cycle have no head and are dropped.
    """
    node, prev = F.col("node").cast("long"), F.col("prev").cast("long")
    start = nodes.select(
        *near, node.alias("node"), prev.alias("jump"), F.when(prev.isNull(), 0).otherwise(1).cast("long").alias("rank"),
        F.when(prev.isNull(), node).alias("head"),
    )
    by_place = start.repartitionByRange(*near, "node").select("node", "jump", "rank", "head")
    return _follow(cut_lineage(by_place.mapInPandas(_local_jumps, _STATE)))


def _follow(state: DataFrame) -> DataFrame:
    """(node, head, rank) of ``state`` (node, jump, rank, head), whose pointers leave their partition."""
    done = state.where("jump IS NULL").select("node", "head", "rank")
    away = state.where("jump IS NOT NULL")
    left = away.count()
    if not left:
        return done
    asked = cut_lineage(state.join(away.select(F.col("jump").alias("node")).distinct().hint("merge"), "node", "left_semi"))
    if asked.count() > SHRINKS * left:
        return _double(state, left)
    solved = _follow(cut_lineage(asked.repartitionByRange("node").mapInPandas(_local_jumps, _STATE)))
    ahead = solved.select(F.col("node").alias("jump"), F.col("head").alias("_h"), F.col("rank").alias("_r"))
    return done.unionByName(away.join(ahead.hint("merge"), "jump").select("node", F.col("_h").alias("head"), (F.col("rank") + F.col("_r")).alias("rank")))


def _double(state: DataFrame, left: int) -> DataFrame:
    """Pointer doubling: about log2 of the longest way rounds."""
    while left:
        done = state.where("jump IS NULL")
        other = state.select(
            F.col("node").alias("jump"),
            F.col("jump").alias("_j"),
            F.col("rank").alias("_r"),
            F.col("head").alias("_h"),
        )
        moved = (
            state.where("jump IS NOT NULL")
            .join(other.hint("merge"), "jump")
            .select("node", F.col("_j").alias("jump"), (F.col("rank") + F.col("_r")).alias("rank"), F.col("_h").alias("head"))
        )
        state = cut_lineage(done.unionByName(moved))
        now = state.where("jump IS NOT NULL").count()
        # the node next to a settled one settles in every round; where none does, all lead into cycles
        if now == left:
            break
        left = now
    return state.where("jump IS NULL").select("node", "head", "rank")
