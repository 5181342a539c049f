"""Filters on finished blocks, and the contig pairs they rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigloom.operators.tiled import ordered_neighbours


def frame_length(begin: str, end: str) -> Column:
    return F.greatest(F.col(end) - F.col(begin) + 1, F.lit(0))


def min_block_size(blocks: DataFrame, min_reads: int) -> DataFrame:
    return blocks.where(F.col("num_reads") >= min_reads)


def pairing_evidence(blocks: DataFrame) -> DataFrame:
    """Blocks per contig pair."""
    return blocks.groupBy("m_ctg", "s_ctg").agg(F.count("*").alias("evidence"))


def single_link_pairs(blocks: DataFrame) -> DataFrame:
    """Contig pairs in which one side has no other partner."""
    links = blocks.select("m_ctg", "s_ctg").distinct()
    m_deg = links.groupBy("m_ctg").agg(F.count("*").alias("m_deg"))
    s_deg = links.groupBy("s_ctg").agg(F.count("*").alias("s_deg"))
    return (
        links.join(m_deg, "m_ctg")
        .join(s_deg, "s_ctg")
        .where((F.col("m_deg") == 1) | (F.col("s_deg") == 1))
        .select("m_ctg", "s_ctg")
    )


def coverage_ratios(blocks: DataFrame) -> DataFrame:
    """Block reads over all reads on each side; NULL for 0/0, infinity for x/0."""

    def ratio(side: str) -> Column:
        part, whole = F.col(f"{side}_block_reads_len"), F.col(f"{side}_reads_len")
        return F.when((whole == 0) & (part > 0), F.lit(float("inf"))).otherwise(
            F.try_divide(part, whole)
        )

    return blocks.withColumn("m_ratio", ratio("m")).withColumn("s_ratio", ratio("s"))


def coverage_ratio_filter(blocks: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Drop blocks whose better side is covered less than ``threshold``.

    An undefined master ratio keeps the block, an undefined slave ratio leaves
    the decision to the master.
    """
    better = F.greatest("m_ratio", F.coalesce("s_ratio", "m_ratio"))
    return coverage_ratios(blocks).where(F.col("m_ratio").isNull() | (better >= threshold))


def min_coverage_filter(blocks: DataFrame, single_links: DataFrame, threshold: float) -> DataFrame:
    """Drop thin blocks, unless their contig pair is a single link.

    Coverage is taken on the side with the larger ratio (master on a tie).
    ``blocks`` carries m_ratio and s_ratio.
    """
    flagged = blocks.join(
        single_links.select("m_ctg", "s_ctg", F.lit(True).alias("_single")), ["m_ctg", "s_ctg"], "left"
    )
    on_master = F.col("m_ratio") >= F.coalesce("s_ratio", F.lit(-1.0))
    cov = F.when(
        on_master, F.col("m_block_reads_len") / frame_length("m_begin", "m_end")
    ).otherwise(F.col("s_block_reads_len") / frame_length("s_begin", "s_end"))
    return (
        flagged.withColumn("block_cov", cov)
        .where(F.col("_single").isNotNull() | (F.col("block_cov") >= threshold))
        .drop("_single")
    )


def frame_read_overlap(
    frame_begin: Column, frame_end: Column, read_start: Column, read_last: Column, minimum: int = 0
) -> Column:
    """Frame and read share at least ``minimum`` bases; 0 lets neighbours touch."""
    return (frame_end - read_start + 1 >= minimum) & (read_last - frame_begin + 1 >= minimum)


def frame_overlap_percent(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    """Share of the second frame covered by the first, in percent."""
    common = F.least(a_end, b_end) - F.greatest(a_begin, b_begin) + 1
    return 100.0 * F.greatest(common, F.lit(0)) / (b_end - b_begin + 1)


def block_length_filter(blocks: DataFrame, contigs_m: DataFrame, contigs_s: DataFrame) -> DataFrame:
    """Drop blocks short on both contigs that a neighbour on the same contig overlaps.

    One simultaneous pass per side: short means below min(500, 0.3 * contig),
    overlapped means at least 0.5 % of the frame lies under the neighbour.
    """
    out = blocks
    for side, contigs in (("m", contigs_m), ("s", contigs_s)):
        other, other_contigs = ("s", contigs_s) if side == "m" else ("m", contigs_m)
        sized = out
        for s, c in ((side, contigs), (other, other_contigs)):
            sized = sized.join(
                c.select(F.col("ctg_id").alias(f"{s}_ctg"), F.col("length").alias(f"_{s}_len")), f"{s}_ctg"
            )
        begin, end = f"{side}_begin", f"{side}_end"
        near = ordered_neighbours(
            sized,
            [f"{side}_ctg"],
            begin,
            [F.col(begin), F.col(end).desc(), F.col(f"{other}_ctg"), F.col(f"{other}_begin")],
            [begin, end],
        )

        def short(s: str) -> Column:
            return frame_length(f"{s}_begin", f"{s}_end") < F.least(F.lit(500.0), 0.3 * F.col(f"_{s}_len"))

        def covered(which: str) -> Column:
            pct = frame_overlap_percent(
                F.col(f"{which}_{begin}"), F.col(f"{which}_{end}"), F.col(begin), F.col(end)
            )
            return F.coalesce(pct >= 0.5, F.lit(False))

        drop = short("m") & short("s") & (covered("next") | covered("prev"))
        out = near.where(~drop).select(*blocks.columns)
    return out


def block_overlaps(blocks: DataFrame, side: str = "m", percent: float = 95.0) -> DataFrame:
    """Report neighbours on one contig of which the later is covered by ``percent``."""
    other = "s" if side == "m" else "m"
    begin, end = f"{side}_begin", f"{side}_end"
    near = ordered_neighbours(
        blocks,
        [f"{side}_ctg"],
        begin,
        [F.col(begin), F.col(end).desc(), F.col(f"{other}_ctg"), F.col(f"{other}_begin")],
        [begin, end, f"{other}_ctg"],
    )
    pct = frame_overlap_percent(
        F.col(begin), F.col(end), F.col(f"next_{begin}"), F.col(f"next_{end}")
    )
    return near.withColumn("overlap_pct", pct).where(F.col("overlap_pct") >= percent)


def shares_contig(a: str, b: str, side: str | None = None) -> Column:
    """Whether the blocks in struct columns ``a`` and ``b`` lie on one contig of ``side`` (m, s; either by default)."""
    same = {x: F.col(f"{a}.{x}_ctg") == F.col(f"{b}.{x}_ctg") for x in ("m", "s")}
    return same["m"] | same["s"] if side is None else same[side]
