"""Relative strands of contigs from the strand votes of their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigloom.operators.spanning import best_forest, euler_tour, rooted, sums_below, tops_below_common, tree_blocks
from contigloom.operators.tiled import exclusive_prefix
from contigloom.session import cut_lineage


def strand_evidence(blocks: DataFrame) -> DataFrame:
    """Reads in blocks that agree / disagree in strand, per contig pair (master is '+')."""
    same = F.col("s_strand") == "+"
    return blocks.groupBy("m_ctg", "s_ctg").agg(
        F.sum(F.when(same, F.col("num_reads")).otherwise(0)).alias("positive"),
        F.sum(F.when(same, 0).otherwise(F.col("num_reads"))).alias("negative"),
    )


def combine(p: Column, q: Column) -> Column:
    """Probability that two steps in a row keep the strand."""
    return p * q + (1 - p) * (1 - q)


def strand_of_probability(p: Column) -> Column:
    return F.when(p < 0.5, "-").when(p > 0.5, "+").otherwise("?")


def strand_of_evidence(positive: Column, negative: Column) -> Column:
    return F.when(positive < negative, "-").when(positive > negative, "+").otherwise("?")


def relative_strands(evidence: DataFrame, components: DataFrame) -> DataFrame:
    """(asm, ctg, component, prob, strand) against the smallest master contig.

    2 * prob - 1 multiplies along a path.  In a component without cycles one
    path leads to every contig, and its product comes from an Euler tour of the
    tree (ranked by pointer doubling, then a running sum), so a genome-long
    chain stays distributed.

    With cycles, the best-supported spanning tree is cut into biconnected
    blocks.  Inside a block a contig takes the mean over its tree path from the
    block's entry and the paths that leave the tree once (over one further pair
    of contigs), each weighted by the smallest evidence on it; in a ring these
    are all paths.  Between blocks the means multiply along the tree of entries.
    """
    of_master = components.where("asm = 'm'").select(F.col("ctg").alias("m_ctg"), "component")
    net = (F.col("positive") - F.col("negative")) / (F.col("positive") + F.col("negative"))
    edges = cut_lineage(
        evidence.join(of_master.hint("merge"), "m_ctg").select(
            "component", (F.col("m_ctg") * 2).alias("a"), (F.col("s_ctg") * 2 + 1).alias("b"),
            net.alias("x"), (F.col("positive") + F.col("negative")).cast("long").alias("weight"),
        )
    )
    size = components.groupBy("component").agg(F.count("*").alias("nv"))
    shape = (
        edges.groupBy("component").agg(F.count("*").alias("ne")).join(size.hint("merge"), "component")
        .select("component", (F.col("ne") == F.col("nv") - 1).alias("tree"))
    )
    shaped = cut_lineage(edges.join(shape.hint("merge"), "component"))
    steps = shaped.where("tree").select("component", "a", "b", "x")
    rings = shaped.where("NOT tree").drop("tree")
    if rings.limit(1).count():
        steps = steps.unionByName(_block_steps(rings))
    return _tree_probabilities(steps).select(
        F.when(F.col("vertex") % 2 == 0, "m").otherwise("s").alias("asm"),
        F.expr("vertex div 2").alias("ctg"),
        "component",
        "prob",
        strand_of_probability(F.col("prob")).alias("strand"),
    )


def _factors(x: Column) -> list[Column]:
    """A factor as sums: log size, sign changes, zeros (a zero leaves the other two alone)."""
    size = F.abs(x)
    return [
        F.when(size > 0, F.log(size)).otherwise(0.0).alias("mag"),
        F.when(x < 0, 1).otherwise(0).cast("long").alias("neg"),
        F.when(x == 0, 1).otherwise(0).cast("long").alias("zero"),
    ]


def _product(mag: Column, neg: Column) -> Column:
    return F.when(neg % 2 == 0, F.exp(mag)).otherwise(-F.exp(mag))


def _tree_probabilities(steps: DataFrame) -> DataFrame:
    """(component, vertex, prob) along trees (component, a, b, x); the root is the component's master contig."""
    roots = steps.select("component", (F.col("component") * 2).alias("u")).distinct()
    tour = euler_tour(steps, roots)
    sign = F.when(F.col("rank") < F.col("back"), 1).otherwise(-1)
    parts = tour.select("*", *_factors(F.col("x")))
    walked = parts.withColumns({c: sign * F.col(c) for c in ("mag", "neg", "zero")})
    run = exclusive_prefix(
        walked, ["component"], "rank", {"_m": ("sum", "mag"), "_n": ("sum", "neg"), "_z": ("sum", "zero")}
    )
    product = _product(F.col("_m") + F.col("mag"), F.col("_n") + F.col("neg"))
    # rounded, so that two equal chances stay equal whatever the order of the sums
    prob = F.when(F.col("_z") + F.col("zero") > 0, 0.5).otherwise(F.round((1 + product) / 2, 12))
    clamped = F.least(F.greatest(prob, F.lit(0.0)), F.lit(1.0))
    reached = run.where("rank < back").select("component", F.col("v").alias("vertex"), clamped.alias("prob"))
    return reached.unionByName(roots.select("component", F.col("u").alias("vertex"), F.lit(1.0).alias("prob")))


def _from_entry(member: DataFrame) -> DataFrame:
    """(vertex, low, mag, neg, zero) along the tree path from the block's entry: pointers double until they reach it.

    ``member``: vertex, parent, entry and the values of the vertex's edge to its parent.
    """
    values = ["low", "mag", "neg", "zero"]
    state = cut_lineage(member.select("vertex", F.when(F.col("parent") != F.col("entry"), F.col("parent")).alias("up"), *values))
    while state.where("up IS NOT NULL").limit(1).count():
        above = state.select(F.col("vertex").alias("up"), F.col("up").alias("_up"), *[F.col(v).alias(f"_{v}") for v in values])
        moved = state.where("up IS NOT NULL").join(above.hint("merge"), "up")
        moved = moved.select(
            "vertex", F.col("_up").alias("up"), F.least("low", "_low").alias("low"), *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values[1:]]
        )
        state = cut_lineage(state.where("up IS NULL").unionByName(moved))
    return state.drop("up")


def _block_steps(edges: DataFrame) -> DataFrame:
    """(component, a, b, x): from the entry of its block to every contig, the mean of its paths.

    In a maximum spanning tree an edge outside it is the weakest of the ring it
    closes.  So a path that leaves the tree over it has the smaller of its
    evidence and of the tree path to the ring: one number for all contigs that
    the ring gives a second path.  These sums are taken over the tree at once,
    once the ends' products are known.
    """
    roots = cut_lineage(edges.select("component", (F.col("component") * 2).alias("u")).distinct())
    chosen = cut_lineage(best_forest(edges).withColumn("in_tree", F.lit(True)))
    split = cut_lineage(edges.join(chosen.hint("merge"), ["a", "b"], "left"))
    tour = cut_lineage(euler_tour(split.where("in_tree").select("component", "a", "b", "x", "weight"), roots))
    tree = cut_lineage(rooted(tour, roots))
    chords = split.where("in_tree IS NULL").select("component", "a", "b", F.col("x").alias("cx"), F.col("weight").alias("cw"))
    chords = cut_lineage(tops_below_common(tree, chords))
    blocks = cut_lineage(tree_blocks(tree, chords))

    own = tour.where("rank < back").select("component", F.col("v").alias("vertex"), F.col("u").alias("parent"), F.col("weight").alias("low"), *_factors(F.col("x")))
    member = cut_lineage(own.join(blocks.hint("merge"), "vertex"))
    reach = cut_lineage(_from_entry(member))
    at = member.select("component", "vertex", "block", "entry").join(reach.hint("merge"), "vertex")

    # a chord's ring hangs at ``common``; from the entry itself nothing is weaker
    named = lambda c: reach.select(*[F.col(x).alias(f"{c}_{x}") for x in reach.columns])
    home = blocks.select(F.col("vertex").alias("_top"), "block", "entry")
    spans = chords.withColumn("_top", F.coalesce("top_a", "top_b")).join(home.hint("merge"), "_top")
    for c, vertex in (("ea", "a"), ("eb", "b"), ("ec", "common")):
        spans = spans.join(named(c).hint("merge"), F.col(vertex) == F.col(f"{c}_vertex"), "left")
    at_entry = lambda c, vertex, x: F.when(F.col(vertex) == F.col("entry"), 0).otherwise(F.col(f"{c}_{x}"))
    held = F.when(F.col("common") == F.col("entry"), F.col("cw")).otherwise(F.least("cw", "ec_low"))
    whole = {x: at_entry("ea", "a", x) + at_entry("eb", "b", x) for x in ("mag", "neg")}
    mag, neg, zero = _factors(F.col("cx"))
    spans = cut_lineage(
        spans.select(
            "block", "a", "b", "common", held.alias("w"), at_entry("ea", "a", "zero").alias("za"), at_entry("eb", "b", "zero").alias("zb"),
            zero.alias("zc"), (held * _product(whole["mag"] + mag, whole["neg"] + neg)).alias("g"),
        )
    )
    weights = [spans.select(F.col(c).alias("vertex"), "block", (F.col("w") * k).alias("w")) for c, k in (("a", 1), ("b", 1), ("common", -2))]
    events = weights[0].unionByName(weights[1]).unionByName(weights[2])
    at = cut_lineage(sums_below(tree, events, ["block"], cut_lineage(at), ["w"]))
    # a path counts where no zero lies on it: none on the other end's side, none between the contig and the near end
    ends = [
        spans.where(f"zc = 0 AND {far} = 0").select(F.col(c).alias("vertex"), "block", F.col(near).alias("zero"), "g")
        for c, near, far in (("a", "za", "zb"), ("b", "zb", "za"))
    ]
    inner = spans.where("zc = 0 AND za = 0 AND zb = 0").select(F.col("common").alias("vertex"), "block", F.lit(0).cast("long").alias("zero"), (-2 * F.col("g")).alias("g"))
    events = ends[0].unionByName(ends[1]).unionByName(inner)
    at = sums_below(tree, events, ["block", "zero"], at, ["g"])
    straight = _product(F.col("mag"), F.col("neg"))
    total = F.when(F.col("zero") == 0, F.col("low") * straight).otherwise(0.0) + F.when(straight != 0, F.col("g") / straight).otherwise(0.0)
    return cut_lineage(at.select("component", F.col("entry").alias("a"), F.col("vertex").alias("b"), (total / (F.col("low") + F.col("w"))).alias("x")))
