"""Merge two assemblies of one genome, from blocks to merged contigs.

Tables that grow with the graph meet by shuffles (the merge hints).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigloom.operators import alignment as al
from contigloom.operators import assembly_graph as ag
from contigloom.operators import block_filters as bf
from contigloom.operators import contig_sets as cs
from contigloom.operators import coverage
from contigloom.operators import edges as ev
from contigloom.operators import forks as fk
from contigloom.operators import merge as mg
from contigloom.operators import sequence_tiles as sq
from contigloom.operators import strands as st
from contigloom.session import cut_lineage


@dataclass
class Assembly:
    """One assembly: alignments of its reads, contigs with sequence, library statistics.

    ``mp_aln`` / ``mp_stats`` hold mate-pair libraries, where there are any.
    """

    aln: DataFrame
    contigs: DataFrame  # ctg_id, name, length, sequence
    stats: DataFrame  # lib_id, isize_mean, isize_std
    mp_aln: DataFrame | None = None
    mp_stats: DataFrame | None = None

    @cached_property
    def _tiles(self) -> dict[str, DataFrame]:
        return {}

    def tiles(self, side: str) -> DataFrame:
        """The sequences as tiles, written once; ``side`` is m or s."""
        if side not in self._tiles:
            self._tiles[side] = cut_lineage(sq.tiles(self.contigs, side))
        return self._tiles[side]

    @property
    def dictionary(self) -> DataFrame:
        return self.contigs.select("ctg_id", "name", "length")


@dataclass
class Graph:
    vertices: DataFrame  # numbered blocks with component
    edges: DataFrame  # src, dst, kind
    member: DataFrame  # vertex, chain
    hull: DataFrame  # chain, hulls
    chain_edges: DataFrame  # src, dst, kind, weight, rnum
    components: DataFrame


def filter_blocks(
    blocks: DataFrame, min_reads: int, coverage_ratio: float, glob_cov_master: float, glob_cov_slave: float
) -> DataFrame:
    """Size, coverage-ratio and minimum-coverage filters, in that order.

    Single links are those of the blocks before the coverage filters.
    """
    if coverage_ratio < 0:
        raise ValueError("the coverage threshold must not be negative")
    sized = cut_lineage(bf.min_block_size(blocks, min_reads))
    single = bf.single_link_pairs(sized)
    kept = bf.coverage_ratio_filter(sized, coverage_ratio)
    return bf.min_coverage_filter(kept, single, min(glob_cov_master, glob_cov_slave) / 2)


def filter_by_libraries(
    blocks: DataFrame, min_reads: int, coverage_ratio: float, master_stats: DataFrame, slave_stats: DataFrame
) -> DataFrame:
    """``filter_blocks`` with the coverage of both sides summed over their libraries (a column coverage)."""
    both = [coverage.global_coverage(s).first().glob_coverage or 0.0 for s in (master_stats, slave_stats)]
    return filter_blocks(blocks, min_reads, coverage_ratio, *both)


def build_graph(blocks: DataFrame) -> Graph:
    """Components, strands, ordering edges and chains, without edge weights."""
    blocks = cut_lineage(blocks)
    comps = cut_lineage(ag.contig_components(ag.contig_pairs(blocks)))
    strands = cut_lineage(st.relative_strands(st.strand_evidence(blocks), comps))
    vertices = ag.number_blocks(ag.with_component(blocks, comps))
    edges = cut_lineage(ag.assembly_edges(vertices, strands))
    member, between = ag.compact_chains(vertices, edges)
    hull = cut_lineage(ag.vertex_hull(vertices, member))
    return Graph(vertices, edges, member, hull, cut_lineage(between), comps)


def weigh_edges(graph: Graph, master: Assembly, slave: Assembly) -> DataFrame:
    """Edges between chains with weight and reads from the matching assembly."""
    scored = []
    for side, kind, asm in (("m", "MASTER", master), ("s", "SLAVE", slave)):
        begin, end, ctg = f"{side}_begin", f"{side}_end", f"{side}_ctg"
        a = graph.hull.select(
            F.col("chain").alias("src"), F.col(ctg).alias("ctg"), F.col(begin).alias("r1_begin"), F.col(end).alias("r1_end")
        )
        b = graph.hull.select(F.col("chain").alias("dst"), F.col(begin).alias("r2_begin"), F.col(end).alias("r2_end"))
        size = asm.dictionary.select(F.col("ctg_id").alias("ctg"), F.col("length").alias("seq_len"))
        spans = graph.chain_edges.where(F.col("kind") == kind).join(a.hint("merge"), "src").join(b.hint("merge"), "dst").join(size.hint("merge"), "ctg")
        spans = cut_lineage(
            spans.select(F.struct("src", "dst").alias("edge_id"), "kind", "ctg", "r1_begin", "r1_end", "r2_begin", "r2_end", "seq_len")
        )
        pe = ev.edge_scores(spans.drop("kind"), asm.aln, asm.stats).select(
            "edge_id", F.col("weight").alias("pw"), F.col("rnum").alias("pn")
        )
        if asm.mp_aln is None:
            both = pe.withColumn("mw", F.lit(ev.TOO_FEW)).withColumn("mn", F.lit(0))
        else:
            mp = ev.edge_scores(spans.drop("kind"), asm.mp_aln, asm.mp_stats).select(
                "edge_id", F.col("weight").alias("mw"), F.col("rnum").alias("mn")
            )
            both = pe.join(mp, "edge_id")
        weight, rnum = ev.combine_libraries(F.col("pw"), F.col("pn"), F.col("mw"), F.col("mn"))
        scored.append(
            both.select("edge_id.src", "edge_id.dst", F.lit(kind).alias("kind"), weight.alias("weight"), rnum.cast("long").alias("rnum"))
        )
    return cut_lineage(reduce(DataFrame.unionByName, scored))


@dataclass
class Merged:
    segments: DataFrame  # pctg, ordinal, offset, asm, ctg, begin, end, rev, length
    lists: DataFrame
    extents: DataFrame
    used_master: DataFrame
    used_slave: DataFrame
    unmerged_slave: DataFrame
    classes: DataFrame
    no_blocks_slave: DataFrame  # slave contigs without blocks before the filters
    lost_blocks_slave: DataFrame  # and those that lost theirs to the filters


def resolve(graph: Graph, weighted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fork-free merge vertices and edges, and the class of every component.

    Components with a cycle are not merged.
    """
    classes = cut_lineage(ag.graph_classes(graph.vertices, graph.edges))
    comp_of = graph.member.where("vertex = chain").join(
        graph.vertices.select("vertex", F.col("component").alias("comp")).hint("merge"), "vertex"
    ).select("vertex", "comp")
    cyclic = classes.where("graph_class = 'cyclic'").select(F.col("component").alias("comp"))
    comp_of = cut_lineage(comp_of.join(cyclic.hint("merge"), "comp", "left_anti"))
    vertices = fk.merge_vertices(graph.hull).join(comp_of.select("vertex").hint("merge"), "vertex", "left_semi")
    edges = weighted.join(comp_of.select(F.col("vertex").alias("src")).hint("merge"), "src", "left_semi")
    v, e = fk.resolve_forks(cut_lineage(vertices), cut_lineage(edges.select("src", "dst", "kind", "weight")), comp_of)
    return cut_lineage(v), cut_lineage(e), classes


def tile_store(master: Assembly, slave: Assembly) -> DataFrame:
    return master.tiles("m").unionByName(slave.tiles("s"))


def align_lists(graph: Graph, lists: DataFrame, master: Assembly, slave: Assembly) -> DataFrame:
    """Alignment extents of the merge blocks in ``lists``."""
    rows = al.chain_frames(graph.vertices, graph.member).join(lists.select("vertex", *al.FLAGS).hint("merge"), "vertex")
    return cut_lineage(al.align_merge_blocks(rows, tile_store(master, slave)))


def merge(blocks_before: DataFrame, blocks: DataFrame, master: Assembly, slave: Assembly) -> Merged:
    """Merge along ``blocks``, the filtered part of ``blocks_before``."""
    blocks = cut_lineage(blocks)
    graph = build_graph(blocks)
    vertices, edges, classes = resolve(graph, weigh_edges(graph, master, slave))
    lists = cut_lineage(mg.merge_lists(vertices, edges))
    extents = align_lists(graph, lists, master, slave)

    def size(asm: Assembly, side: str) -> DataFrame:
        return asm.dictionary.select(F.col("ctg_id").alias(f"{side}_ctg"), F.col("length").alias(f"{side}_size"))

    aligned = lists.join(extents.hint("merge"), "vertex").join(size(master, "m").hint("merge"), "m_ctg").join(size(slave, "s").hint("merge"), "s_ctg")
    ordered = cut_lineage(mg.split_and_sort(mg.split_by_alignment(aligned)))
    chosen = mg.choose_regions(ordered, master.aln, slave.aln, master.stats, slave.stats)
    stitched = cut_lineage(mg.stitch(chosen))
    comp_of = graph.vertices.select("vertex", F.col("component").alias("comp"))
    merged = cut_lineage(mg.number_merged(stitched, comp_of))
    used_m, used_s = mg.used_contigs(stitched, "m"), mg.used_contigs(stitched, "s")
    left = cs.unused_contigs(master.dictionary, used_m)
    count = merged.agg(F.coalesce(F.max("pctg") + 1, F.lit(0)).alias("n")).scalar()
    segments = cut_lineage(mg.with_offsets(merged.unionByName(mg.single_contigs(left, count))))
    no_blocks = cs.contigs_without_blocks(slave.dictionary, blocks_before, "s")
    lost = cs.contigs_losing_blocks(slave.dictionary, blocks_before, blocks, "s")
    return Merged(
        segments, ordered, extents, used_m, used_s,
        cs.unused_contigs(slave.dictionary, used_s, no_blocks, lost), classes, no_blocks, lost,
    )


def merged_pieces(result: Merged, master: Assembly, slave: Assembly) -> DataFrame:
    return mg.segment_bases(result.segments, tile_store(master, slave))


def write(result: Merged, master: Assembly, slave: Assembly, prefix: str) -> None:
    """Merged contigs, their descriptor, slave contigs without blocks (before and after the filters) and left over, and the graph census."""
    from contigloom.sinks import textfiles as sink

    lines = mg.fasta_of_segments(merged_pieces(result, master, slave))
    names = result.segments.select("pctg").distinct().withColumn(
        "name", F.concat(F.lit(mg.NAME_PREFIX), F.col("pctg").cast("string"))
    )
    sink.write_fasta(names, lines, "pctg", f"{prefix}.fasta")
    merged_rows = result.segments.join(result.used_master.select(F.col("ctg_id").alias("ctg")), "ctg", "left_semi").where("asm = 'm'")
    last = merged_rows.agg(F.max("pctg")).first()[0]
    rows = mg.descriptor(result.segments, master.dictionary, slave.dictionary)
    sink.write_descriptor(rows, f"{prefix}.pctgs", -1 if last is None else last + 1)
    for name, some in (("noblocks.BF", result.no_blocks_slave), ("noblocks.AF", result.lost_blocks_slave), ("notmerged", result.unmerged_slave)):
        sink.write_contigs(slave.contigs.join(some.select("ctg_id"), "ctg_id", "left_semi"), f"{prefix}.{name}.fasta")
    sink.write_stats(ag.class_census(result.classes), f"{prefix}.stats")
