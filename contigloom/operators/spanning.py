"""Rooted spanning trees as tables: maximum spanning forest, Euler tour, common ancestors, blocks.

Nothing here holds a component in one task: forests grow by rounds in which
every cluster takes its best edge, tours are ranked by pointer doubling, and
ancestors are found by tables of 1, 2, 4, ... steps.  Tables that grow with the
graph meet by shuffles (the merge hints): each is small enough to be broadcast
for long, but there are so many that the driver would collect the graph over and over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigloom.operators.components import connected_components, rank_chains
from contigloom.operators.tiled import exclusive_prefix, number_rows, ordered_neighbours
from contigloom.session import cut_lineage


def _local_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leave out edges that close a cycle of better edges within one partition: they are in no best forest."""
    held = [*batches]
    if not held:
        return
    edges = pd.concat(held, ignore_index=True).sort_values(["weight", "a", "b"], ascending=[False, True, True], kind="stable")
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent.setdefault(parent[v], parent[v])
            v = parent[v]
        return v

    kept = []
    for a, b in zip(edges["a"].tolist(), edges["b"].tolist()):
        x, y = root(a), root(b)
        kept.append(x != y)
        parent[max(x, y)] = min(x, y)
    yield edges[kept]


def best_forest(edges: DataFrame) -> DataFrame:
    """(a, b) of the maximum spanning forest of ``edges``: a, b (a pair once), weight.

    Edges are ranked by weight, then by the smaller a, b.  In every round each
    cluster takes its best edge to another one, so clusters at least halve.
    """
    best = cut_lineage(edges.select("a", "b", "weight").mapInPandas(_local_best, "a long, b long, weight long"))
    left = best.select("a", "b", "weight", F.col("a").alias("u"), F.col("b").alias("v"))
    taken = []
    while left.limit(1).count():
        order = F.struct("weight", (-F.col("a")).alias("_a"), (-F.col("b")).alias("_b"))
        ends = left.unionByName(left.select("a", "b", "weight", F.col("v").alias("u"), F.col("u").alias("v")))
        chosen = cut_lineage(ends.groupBy("u").agg(F.max_by(F.struct("a", "b", "v"), order).alias("e")).select("u", "e.*"))
        taken.append(chosen.select("a", "b"))
        label = cut_lineage(connected_components(chosen.select("u", "v")))
        of = lambda c: label.select(F.col("vertex").alias(c), F.col("component").alias(f"_{c}"))
        moved = left.join(of("u").hint("merge"), "u").join(of("v").hint("merge"), "v").where("_u <> _v")
        left = cut_lineage(moved.select("a", "b", "weight", F.col("_u").alias("u"), F.col("_v").alias("v")))
    forest = taken[0] if taken else best.select("a", "b")
    for more in taken[1:]:
        forest = forest.unionByName(more)
    return forest.distinct()


def euler_tour(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(component, u, v, rank, back, and the columns of ``edges``) of both arcs of every tree edge.

    ``edges``: component, a, b, ...; ``roots``: component, u.  ``rank`` is the
    arc's place in the tour of its component, ``back`` that of its opposite: the
    arc leads away from the root where rank < back, and the vertices below v are
    those entered from rank to back.
    """
    more = [c for c in edges.columns if c not in ("component", "a", "b")]
    one_way = edges.select("component", F.col("a").alias("u"), F.col("b").alias("v"), *more)
    arcs = one_way.unionByName(one_way.select("component", F.col("v").alias("u"), F.col("u").alias("v"), *more))
    arcs = cut_lineage(number_rows(arcs, "u", "v", [F.col("v")], "arc"))
    around = ordered_neighbours(arcs, ["u"], "v", [F.col("v")], ["arc"])
    first = arcs.groupBy("u").agg(F.min("arc").alias("first_arc"))
    # after arriving over u -> v, leave v by the arc that follows v -> u
    leave = around.join(first.hint("merge"), "u").select("component", "u", "v", F.coalesce("next_arc", "first_arc").alias("leave"), "arc")
    arrive = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("arc").alias("arrive"))
    heads = first.join(roots.select("u"), "u").select(F.col("first_arc").alias("leave"), F.lit(True).alias("is_head"))
    tour = (
        leave.join(arrive.hint("merge"), ["u", "v"])
        .join(heads.hint("merge"), "leave", "left")
        .select(
            "component", F.least("u", "v").alias("place"), F.col("leave").alias("node"), F.when(F.col("is_head").isNull(), F.col("arrive")).alias("prev")
        )
    )
    # arcs are numbered by the vertex they leave; the smaller end stays closer to the way a tour takes
    rank = rank_chains(tour, "component", "place").select(F.col("node").alias("arc"), "rank")
    ranked = cut_lineage(arcs.join(rank.hint("merge"), "arc").drop("arc"))
    back = ranked.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("rank").alias("back"))
    return ranked.join(back.hint("merge"), ["u", "v"])


def rooted(tour: DataFrame, roots: DataFrame) -> DataFrame:
    """(component, vertex, parent, enter, leave) of every vertex; a root has no parent and spans all."""
    below = tour.where("rank < back").select(
        "component", F.col("v").alias("vertex"), F.col("u").alias("parent"), F.col("rank").alias("enter"), F.col("back").alias("leave")
    )
    top = roots.select("component", F.col("u").alias("vertex"), F.lit(None).cast("long").alias("parent"), F.lit(-1).cast("long").alias("enter"))
    return below.unionByName(top.withColumn("leave", F.lit((1 << 62)).cast("long")))


def tops_below_common(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``top_a``, ``top_b``, ``common``.

    ``common`` is the last common ancestor, ``top_a`` its child on the way to a
    (NULL where a is the ancestor itself).  An end climbs 2**k steps, k falling,
    as long as that does not lead above the other end.
    """
    steps = [cut_lineage(tree.where("parent IS NOT NULL").select("vertex", F.col("parent").alias("up")))]
    while True:
        last = steps[-1]
        longer = cut_lineage(last.join(last.select(F.col("vertex").alias("up"), F.col("up").alias("_up")), "up").select("vertex", F.col("_up").alias("up")))
        if not longer.limit(1).count():
            break
        steps.append(longer)
    span = tree.select("vertex", "enter", "leave")
    at = lambda c: span.select(*[F.col(x).alias(f"{c}_{x}") for x in span.columns]).hint("merge")
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(at("own"), F.col("a") == F.col("own_vertex")).join(at("other"), F.col("b") == F.col("other_vertex"))
    above = lambda c: (F.col(f"{c}_enter") <= F.col("other_enter")) & (F.col(f"{c}_leave") >= F.col("other_leave"))
    ends = cut_lineage(ends.select("a", "b", F.when(~above("own"), F.col("a")).alias("at"), "other_enter", "other_leave"))
    for step in reversed(steps):
        reach = step.withColumnRenamed("vertex", "at").join(at("up"), F.col("up") == F.col("up_vertex")).drop("up_vertex")
        go = ends.join(reach.hint("merge"), "at", "left")
        ends = cut_lineage(go.select("a", "b", F.when(F.col("up").isNotNull() & ~above("up"), F.col("up")).otherwise(F.col("at")).alias("at"), "other_enter", "other_leave"))
    one = ends.select("a", "b", F.col("at").alias("top_a"))
    both = pairs.join(one, ["a", "b"]).join(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("at").alias("top_b")), ["a", "b"])
    parent = tree.select(F.col("vertex").alias("_top"), F.col("parent").alias("common"))
    return both.withColumn("_top", F.coalesce("top_a", "top_b")).join(parent, "_top").drop("_top")


def sums_below(tree: DataFrame, events: DataFrame, keys: list[str], at: DataFrame, values: list[str]) -> DataFrame:
    """``at`` with the sums of ``events`` at and below each of its vertices.

    ``events``: vertex, keys, values; ``at``: vertex, keys, ...; only events of equal keys count.
    """
    place = tree.select("vertex", "enter", "leave")
    nothing = [F.lit(0).alias(v) for v in values]
    asked = at.join(place.hint("merge"), "vertex")
    rows = events.join(place.hint("merge"), "vertex").select(*keys, F.col("enter").alias("place"), *values)
    for end in ("enter", "leave"):
        rows = rows.unionByName(asked.select(*keys, F.col(end).alias("place"), *nothing))
    one = rows.groupBy(*keys, "place").agg(*[F.sum(v).alias(v) for v in values])
    run = cut_lineage(exclusive_prefix(one, keys, "place", {f"_{v}": ("sum", v) for v in values}))
    for end in ("enter", "leave"):
        found = run.select(*keys, F.col("place").alias(end), *[F.coalesce(f"_{v}", F.lit(0)).alias(f"_{end}_{v}") for v in values])
        asked = asked.join(found.hint("merge"), [*keys, end])
    return asked.select(*at.columns, *[(F.col(f"_leave_{v}") - F.col(f"_enter_{v}")).alias(v) for v in values])


def tree_blocks(tree: DataFrame, chords: DataFrame) -> DataFrame:
    """(vertex, block, entry): the biconnected block of every vertex's edge to its parent.

    ``chords``: the other edges with top_a, top_b, common.  Two tree edges in a
    row share a block where a chord spans both; the two topmost edges below a
    chord's common ancestor share one as well.  ``entry`` is the block's vertex
    nearest to the root.
    """
    one, two = F.lit(1).cast("long"), F.lit(-2).cast("long")
    ends = [chords.select(F.col(c).alias("vertex"), one.alias("n")) for c in ("a", "b")]
    events = ends[0].unionByName(ends[1]).unionByName(chords.select(F.col("common").alias("vertex"), two.alias("n")))
    children = cut_lineage(tree.where("parent IS NOT NULL").select("component", "vertex", "parent", F.col("enter").alias("_enter")))
    spans = sums_below(tree, events.join(tree.select("vertex", "component"), "vertex"), ["component"], children, ["n"])
    tops = chords.select(F.col("top_a").alias("vertex")).unionByName(chords.select(F.col("top_b").alias("vertex"))).where("vertex IS NOT NULL")
    spans = spans.join(tops.groupBy("vertex").agg(F.count("*").alias("tops")), "vertex", "left").na.fill(0, ["tops"])
    links = spans.where("n > tops").select(F.col("vertex").alias("u"), F.col("parent").alias("v"))
    links = links.unionByName(chords.where("top_a IS NOT NULL AND top_b IS NOT NULL").select(F.col("top_a").alias("u"), F.col("top_b").alias("v")))
    alone = children.select(F.col("vertex").alias("u"), F.col("vertex").alias("v"))
    label = cut_lineage(connected_components(links.unionByName(alone)).withColumnRenamed("component", "block"))
    member = children.join(label.hint("merge"), "vertex")
    entry = member.groupBy("block").agg(F.min_by("parent", "_enter").alias("entry"))
    return member.join(entry.hint("merge"), "block").select("vertex", "block", "entry")
