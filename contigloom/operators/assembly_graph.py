"""Contig graph and assembly graph: components, ordering edges, chains, classes.

Tables that grow with the graph meet by shuffles (the merge hints): there are
so many joins that the driver would collect the graph over and over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigloom.operators.components import connected_components, rank_chains
from contigloom.operators.ordering import block_order
from contigloom.operators.tiled import island_starts, number_rows, ordered_neighbours
from contigloom.session import cut_lineage


# -- contig graph -----------------------------------------------------------


def contig_pairs(blocks: DataFrame) -> DataFrame:
    """Edges of the bipartite contig graph."""
    return blocks.select("m_ctg", "s_ctg").distinct()


def contig_components(pairs: DataFrame) -> DataFrame:
    """(asm, ctg, component): component is the smallest master id in it.

    Master contig c is vertex 2c and slave contig c is vertex 2c + 1; a
    component always holds a master contig, but its smallest vertex may be a slave.
    """
    pairs = cut_lineage(pairs)
    edges = pairs.select((F.col("m_ctg") * 2).alias("u"), (F.col("s_ctg") * 2 + 1).alias("v"))
    labels = cut_lineage(connected_components(edges))
    first = labels.where("vertex % 2 = 0").groupBy("component").agg(
        F.expr("min(vertex) div 2").alias("first_master")
    )
    return labels.join(first.hint("merge"), "component").select(
        F.when(F.col("vertex") % 2 == 0, "m").otherwise("s").alias("asm"),
        F.expr("vertex div 2").alias("ctg"),
        F.col("first_master").alias("component"),
    )


def with_component(blocks: DataFrame, components: DataFrame) -> DataFrame:
    of_master = components.where("asm = 'm'").select(F.col("ctg").alias("m_ctg"), "component")
    return blocks.join(of_master.hint("merge"), "m_ctg")


# -- assembly graph ---------------------------------------------------------


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Give every block a vertex number in master order."""
    return cut_lineage(number_rows(blocks, "m_ctg", "m_begin", block_order("m"), "vertex"))


def _side_edges(vertices: DataFrame, strands: DataFrame | None, side: str) -> DataFrame:
    """Edges to the next block on the same contig, in the contig's direction.

    A contig of unknown strand ('?') orders nothing.
    """
    near = ordered_neighbours(
        vertices, [f"{side}_ctg"], f"{side}_begin", block_order(side), ["vertex"]
    ).where("next_vertex IS NOT NULL")
    if strands is None:
        strand: Column = F.lit("+")
    else:
        own = strands.where(F.col("asm") == side).select(F.col("ctg").alias(f"{side}_ctg"), "strand")
        near = near.join(own.hint("merge"), f"{side}_ctg")
        strand = F.col("strand")
    back = strand == "-"
    return near.where(strand != "?").select(
        F.when(back, F.col("next_vertex")).otherwise(F.col("vertex")).alias("src"),
        F.when(back, F.col("vertex")).otherwise(F.col("next_vertex")).alias("dst"),
    )


def assembly_edges(vertices: DataFrame, strands: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind): MASTER, SLAVE, or BOTH when both orders agree on an edge.

    ``strands``: asm, ctg, strand; without it every contig runs forward.
    """
    on_master = _side_edges(vertices, strands, "m").withColumn("m", F.lit(1)).withColumn("s", F.lit(0))
    on_slave = _side_edges(vertices, strands, "s").withColumn("m", F.lit(0)).withColumn("s", F.lit(1))
    seen = on_master.unionByName(on_slave).groupBy("src", "dst").agg(F.max("m").alias("m"), F.max("s").alias("s"))
    return seen.select(
        "src",
        "dst",
        F.when((F.col("m") == 1) & (F.col("s") == 1), "BOTH").when(F.col("m") == 1, "MASTER").otherwise("SLAVE").alias("kind"),
    )


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, in_deg, out_deg), vertices without edges included."""
    ends = edges.select(F.col("src").alias("vertex"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("dst").alias("vertex"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    every = ends.unionByName(vertices.select("vertex", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return every.groupBy("vertex").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))


def compact_chains(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse runs of BOTH edges: (vertex, chain) and the edges between chains.

    A BOTH edge uses up both ways out of its source and into its target, so
    these runs are disjoint and lie along one master contig: they are islands
    of the master order.  ``chain`` is the smallest vertex number of the run.
    """
    links = edges.where("kind = 'BOTH'").select(
        F.least("src", "dst").alias("start"), F.greatest("src", "dst").alias("reach"), F.lit(0).alias("one")
    )
    marks = links.unionByName(
        vertices.select(F.col("vertex").alias("start"), F.col("vertex").alias("reach"), F.lit(0).alias("one"))
    )
    # an edge to the following vertex extends the run; a lone vertex reaches itself
    runs = marks.groupBy("one", "start").agg((2 * F.max("reach")).alias("reach")).withColumn("start", 2 * F.col("start"))
    labelled = island_starts(runs, ["one"], "start", "reach", "chain")
    member = cut_lineage(
        labelled.select(F.expr("start div 2").alias("vertex"), F.expr("chain div 2").alias("chain"))
    )
    a = member.select(F.col("vertex").alias("src"), F.col("chain").alias("a"))
    b = member.select(F.col("vertex").alias("dst"), F.col("chain").alias("b"))
    between = (
        edges.where("kind <> 'BOTH'")
        .join(a.hint("merge"), "src")
        .join(b.hint("merge"), "dst")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind")
    )
    return member, between


def vertex_hull(vertices: DataFrame, member: DataFrame, reverse_chain: Column | None = None) -> DataFrame:
    """Per chain: contigs, reads, and the hull of its first and last block on each side.

    Chains follow the master order, so the first and last block are those with
    the smallest and largest vertex number; blocks in between do not count.
    """
    joined = vertices.join(member.hint("merge"), "vertex")
    ends = {}
    for side in ("m", "s"):
        for c in ("begin", "end"):
            col = f"{side}_{c}"
            ends[col] = (F.min_by(col, "vertex"), F.max_by(col, "vertex"))
    pick = {"begin": F.least, "end": F.greatest}
    return joined.groupBy("chain").agg(
        F.first("m_ctg").alias("m_ctg"),
        F.first("s_ctg").alias("s_ctg"),
        F.count("*").alias("blocks"),
        F.sum("num_reads").alias("num_reads"),
        *[pick[col.split("_")[1]](*pair).alias(col) for col, pair in ends.items()],
    )


# -- classes ----------------------------------------------------------------


def _contract_round(edges: DataFrame, drop_forking_ends: bool) -> tuple[DataFrame, DataFrame, bool]:
    """Contract every run of vertices with at most one way in and out.

    ``edges``: comp, src, dst, n (parallel paths an edge stands for).  Returns the
    remaining edges, the cyclic components found, and whether anything changed.
    A run that dead-ends on either side is dropped, one between two other
    vertices becomes an edge.  ``drop_forking_ends`` also drops sources and
    sinks that fork, which keeps cycles but not bubbles.
    """
    vertices = edges.select("comp", F.col("src").alias("vertex")).unionByName(
        edges.select("comp", F.col("dst").alias("vertex"))
    ).distinct()
    deg = degrees(vertices, edges)
    thin = (F.col("in_deg") <= 1) & (F.col("out_deg") <= 1)
    if drop_forking_ends:
        thin = thin | (F.col("in_deg") == 0) | (F.col("out_deg") == 0)
    plain = cut_lineage(deg.where(thin).select("vertex", ((F.col("in_deg") == 0) | (F.col("out_deg") == 0)).alias("loose")))
    if plain.limit(1).count() == 0:
        return edges, edges.select("comp").limit(0), False
    s = plain.select(F.col("vertex").alias("src"), F.lit(True).alias("s_in"))
    d = plain.select(F.col("vertex").alias("dst"), F.lit(True).alias("d_in"))
    tagged = cut_lineage(edges.join(s.hint("merge"), "src", "left").join(d.hint("merge"), "dst", "left"))
    inner = tagged.where("s_in AND d_in")
    loops = plain.select(F.col("vertex").alias("u"), F.col("vertex").alias("v"))
    if drop_forking_ends:
        # a source or sink that forks joins no run: its edges simply go
        forking = deg.where("(in_deg = 0 AND out_deg > 1) OR (out_deg = 0 AND in_deg > 1)").select("vertex")
        gone = cut_lineage(forking)
        tagged = cut_lineage(
            tagged.join(gone.select(F.col("vertex").alias("src")).hint("merge"), "src", "left_anti").join(
                gone.select(F.col("vertex").alias("dst")).hint("merge"), "dst", "left_anti"
            )
        )
        inner = tagged.where("s_in AND d_in")
    runs = cut_lineage(
        connected_components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(loops))
    )
    size = runs.groupBy("component").agg(F.count("*").alias("nv"))
    run_of_src = runs.select(F.col("vertex").alias("src"), F.col("component").alias("run"))
    run_of_dst = runs.select(F.col("vertex").alias("dst"), F.col("component").alias("run"))
    inner_n = inner.join(run_of_src.hint("merge"), "src").groupBy("run", "comp").agg(F.count("*").alias("ne"))
    cyclic = (
        inner_n.join(size.hint("merge"), inner_n["run"] == size["component"]).where("ne >= nv").select("comp")
    )
    into = tagged.where("s_in IS NULL AND d_in").join(run_of_dst.hint("merge"), "dst").select("comp", "run", F.col("src").alias("a"), F.col("n").alias("na"))
    out = tagged.where("s_in AND d_in IS NULL").join(run_of_src.hint("merge"), "src").select("run", F.col("dst").alias("b"), F.col("n").alias("nb"))
    shortcut = into.join(out.hint("merge"), "run").select("comp", F.col("a").alias("src"), F.col("b").alias("dst"), F.greatest("na", "nb").alias("n"))
    kept = tagged.where("s_in IS NULL AND d_in IS NULL").select("comp", "src", "dst", "n")
    merged = kept.unionByName(shortcut)
    self_loops = merged.where("src = dst").select("comp")
    rest = cut_lineage(
        merged.where("src <> dst").groupBy("comp", "src", "dst").agg(F.sum("n").alias("n"))
    )
    return rest, cut_lineage(cyclic.unionByName(self_loops).distinct()), True


def cyclic_components(edges: DataFrame) -> DataFrame:
    """Components (comp) whose edges (comp, src, dst) hold a directed cycle.

    Sources, sinks and runs are contracted away round by round; what cannot be
    contracted any more lies on or between cycles.
    """
    rest = cut_lineage(edges.select("comp", "src", "dst", F.lit(1).cast("long").alias("n")))
    found = [rest.select("comp").limit(0)]
    while rest.limit(1).count():
        rest, cyclic, changed = _contract_round(rest, True)
        found.append(cyclic)
        if not changed:
            found.append(rest.select("comp"))
            break
    return reduce(DataFrame.unionByName, found).distinct()


def bubble_components(edges: DataFrame) -> DataFrame:
    """Components of an acyclic graph in which two paths leave and meet again.

    Runs are contracted first: a double edge that appears is a bubble.  If forks
    remain that contraction cannot remove, tokens (fork, branch) walk the small
    rest, and a vertex reached over two branches of one fork closes a bubble.
    """
    rest = cut_lineage(edges.select("comp", "src", "dst", F.lit(1).cast("long").alias("n")))
    found = [rest.select("comp").limit(0)]
    while rest.limit(1).count():
        rest, _, changed = _contract_round(rest, False)
        double = rest.where("n > 1").select("comp").distinct()
        found.append(double)
        rest = cut_lineage(rest.join(double.hint("merge"), "comp", "left_anti"))
        if not changed:
            found.append(_meeting_branches(rest))
            break
    return reduce(DataFrame.unionByName, found).distinct()


def _meeting_branches(edges: DataFrame) -> DataFrame:
    forks = edges.groupBy("src").agg(F.count("*").alias("k")).where("k > 1").select("src")
    front = cut_lineage(
        edges.join(forks.hint("merge"), "src", "left_semi").select(
            "comp", F.col("src").alias("fork"), F.col("dst").alias("branch"), F.col("dst").alias("at")
        )
    )
    seen = front
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    while front.limit(1).count():
        reached = front.join(step.hint("merge"), "at").select("comp", "fork", "branch", F.col("to").alias("at")).distinct()
        front = cut_lineage(reached.join(seen.hint("merge"), ["fork", "branch", "at"], "left_anti").select("comp", "fork", "branch", "at"))
        seen = cut_lineage(seen.unionByName(front))
    return (
        seen.groupBy("comp", "fork", "at").agg(F.count("*").alias("k")).where("k > 1").select("comp").distinct()
    )


def graph_classes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, graph_class): cyclic, bubbles, forks or linear.

    ``vertices`` carries component; ``edges`` src, dst.
    """
    own = vertices.select(F.col("vertex").alias("src"), F.col("component").alias("comp"))
    placed = cut_lineage(edges.select("src", "dst").join(own.hint("merge"), "src").select("comp", "src", "dst"))
    cyclic = cut_lineage(cyclic_components(placed))
    bubbles = bubble_components(placed.join(cyclic.hint("merge"), "comp", "left_anti"))
    forks = (
        degrees(vertices, edges)
        .where("in_deg > 1 OR out_deg > 1")
        .join(vertices.select("vertex", "component").hint("merge"), "vertex")
        .select(F.col("component").alias("comp"))
        .distinct()
    )
    out = vertices.select(F.col("component").alias("comp")).distinct()
    for name, members in (("cyclic", cyclic), ("bubbles", bubbles), ("forks", forks)):
        out = out.join(members.withColumn(name, F.lit(True)).hint("merge"), "comp", "left")
    return out.select(
        F.col("comp").alias("component"),
        F.when(F.col("cyclic"), "cyclic")
        .when(F.col("bubbles"), "bubbles")
        .when(F.col("forks"), "forks")
        .otherwise("linear")
        .alias("graph_class"),
    )


def class_census(classes: DataFrame) -> DataFrame:
    return classes.groupBy("graph_class").agg(F.count("*").alias("graphs"))


def chain_paths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, head, rank) along the linear paths of a fork-free graph."""
    before = edges.select(F.col("dst").alias("vertex"), F.col("src").alias("prev"))
    nodes = vertices.select("vertex").join(before.hint("merge"), "vertex", "left")
    return rank_chains(nodes.select(F.col("vertex").alias("node"), "prev")).withColumnRenamed("node", "vertex")


# -- reach ------------------------------------------------------------------


def reversed_edges(edges: DataFrame) -> DataFrame:
    """The same graph walked backwards; the other columns stay with their edge."""
    swapped = {"src": F.col("dst"), "dst": F.col("src")}
    return edges.select(*[swapped.get(c, F.col(c)).alias(c) for c in edges.columns])


def next_contigs(vertices: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, asm, ctg): the contigs of all vertices that can be reached from each start, its own included.

    ``vertices``: vertex, m_ctg, s_ctg; ``starts``: vertex.  Stretches without
    forks are ranked by pointer doubling and become one step each, so there are
    as many rounds as forks on the longest way, not vertices.  On
    ``reversed_edges`` these are the contigs before a start.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    ends = cut_lineage(degrees(vertices, edges))
    one_out = ends.where("out_deg = 1").select(F.col("vertex").alias("src"), F.lit(True).alias("one_out"))
    one_in = ends.where("in_deg = 1").select(F.col("vertex").alias("dst"), F.lit(True).alias("one_in"))
    tagged = cut_lineage(edges.join(one_out.hint("merge"), "src", "left").join(one_in.hint("merge"), "dst", "left").select("src", "dst", (F.col("one_out") & F.col("one_in")).alias("thin")))
    before = tagged.where("thin").select(F.col("dst").alias("node"), F.col("src").alias("prev"))
    nodes = vertices.select(F.col("vertex").alias("node")).join(before.hint("merge"), "node", "left")
    ranked = rank_chains(nodes).select(F.col("node").alias("vertex"), "head", "rank")
    # a ring without forks has no head: its vertices stay steps of their own
    place = cut_lineage(
        vertices.select("vertex", "m_ctg", "s_ctg").join(ranked.hint("merge"), "vertex", "left")
        .select("vertex", "m_ctg", "s_ctg", F.coalesce("head", "vertex").alias("chain"), F.coalesce("rank", F.lit(0)).alias("rank"), F.col("head").isNull().alias("ring"))
    )
    at = lambda c: place.select(F.col("vertex").alias(c), F.col("chain").alias(f"{c}_chain"), F.col("ring").alias(f"{c}_ring"))
    steps = tagged.join(at("src").hint("merge"), "src").join(at("dst").hint("merge"), "dst").where("thin IS NULL OR NOT thin OR src_ring OR dst_ring")
    steps = cut_lineage(steps.select(F.col("src_chain").alias("chain"), F.col("dst_chain").alias("to")).distinct())
    own = cut_lineage(starts.select("vertex").distinct().join(place, "vertex").select(F.col("vertex").alias("start"), "chain", F.col("rank").alias("start_rank")))
    front = cut_lineage(own.join(steps, "chain").select("start", F.col("to").alias("chain")).distinct())
    seen = front
    while front.limit(1).count():
        reached = front.join(steps, "chain").select("start", F.col("to").alias("chain")).distinct()
        front = cut_lineage(reached.join(seen, ["start", "chain"], "left_anti"))
        seen = cut_lineage(seen.unionByName(front))
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("asm"), F.col(f"{a}_ctg").alias("ctg")) for a in ("m", "s")])).alias("c")
    of_chain = cut_lineage(place.select("chain", "rank", sides).select("chain", "rank", "c.*"))
    beyond = seen.join(of_chain.select("chain", "asm", "ctg").distinct(), "chain").select("start", "asm", "ctg")
    here = own.join(of_chain, "chain").where("rank >= start_rank").select("start", "asm", "ctg")
    return beyond.unionByName(here).distinct()
