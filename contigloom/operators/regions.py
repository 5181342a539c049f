"""Region scans and the region x read range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 16 kb, the granularity of a linear alignment index
BIN_BITS = 14


def region_scan(aln: DataFrame, ctg: int, begin: int, end: int) -> DataFrame:
    """Alignments overlapping the half-open ``[begin, end)``; plain predicates, so they push down."""
    return aln.where((F.col("ctg") == ctg) & (F.col("pos") < end) & (F.col("epos") > begin))


def jump(aln: DataFrame, ctg: int, begin: int) -> DataFrame:
    """Left-bounded region: everything from ``begin`` on, later contigs included."""
    return aln.where((F.col("ctg") > ctg) | ((F.col("ctg") == ctg) & (F.col("epos") > begin)))


def explode_bins(regions: DataFrame, begin: str, end: str) -> DataFrame:
    """One row per bin of ``[begin, end]``, to give range joins an equality key."""
    return regions.withColumn(
        "_bin",
        F.explode(
            F.sequence(
                F.shiftright(F.col(begin).cast("long"), BIN_BITS), F.shiftright(F.col(end).cast("long"), BIN_BITS)
            )
        ),
    )


def reads_starting_in(
    regions: DataFrame, reads: DataFrame, begin: str, end: str, keys: tuple[str, ...] = ("ctg",)
) -> DataFrame:
    """Join each region to the reads of equal ``keys`` whose start lies in ``[begin, end]``.

    A read has one start bin, so a match is found once; the key (ctg, bin)
    spreads a contig over many partitions and AQE may split a crowded bin.
    """
    r = explode_bins(regions, begin, end)
    a = reads.withColumn("_bin", F.shiftright(F.col("pos").cast("long"), BIN_BITS))
    return r.join(a, [*keys, "_bin"]).where(F.col("pos").between(F.col(begin), F.col(end))).drop("_bin")


def region_join(regions: DataFrame, reads: DataFrame, begin: str = "begin", end: str = "end") -> DataFrame:
    """Join each inclusive region to every overlapping read.

    Both sides are binned; the pair is kept in the bin holding the larger of
    the two starts, the only bin where it is counted.
    """
    r = explode_bins(regions, begin, end)
    a = reads.withColumn("_last", F.col("epos") - 1)
    a = explode_bins(a, "pos", "_last")
    first_common = F.shiftright(F.greatest(F.col(begin), F.col("pos")).cast("long"), BIN_BITS)
    return (
        r.join(a, ["ctg", "_bin"])
        .where((F.col("pos") <= F.col(end)) & (F.col("epos") > F.col(begin)) & (F.col("_bin") == first_common))
        .drop("_bin", "_last")
    )
