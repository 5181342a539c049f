"""Sort orders of alignments and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigloom.operators.regions import region_scan
from contigloom.operators.tiled import exclusive_prefix


def sort_by_position(aln: DataFrame, descending: bool = False) -> DataFrame:
    """Contig, position, library; unmapped records (negative contig) always last."""
    flip = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    return aln.orderBy((F.col("ctg") < 0).asc(), flip("ctg"), flip("pos"), "lib_id")


def sort_by_name(aln: DataFrame, descending: bool = False) -> DataFrame:
    return aln.orderBy(F.col("name").desc() if descending else F.col("name").asc(), "mate")


def sort_by_tag(aln: DataFrame, tag_column: str, descending: bool = False) -> DataFrame:
    """By an optional field; records without it come last."""
    c = F.col(tag_column)
    return aln.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "name")


def sorted_region(aln: DataFrame, ctg: int, begin: int, end: int) -> DataFrame:
    return sort_by_position(region_scan(aln, ctg, begin, end))


def position_ordinal(aln: DataFrame) -> DataFrame:
    """1-based ordinal of each alignment on its contig in position order.

    Counts per position carry the offset; only reads sharing one position are
    ranked against each other.
    """
    per_pos = aln.groupBy("ctg", "pos").agg(F.count("*").alias("_n"))
    base = exclusive_prefix(per_pos, ["ctg"], "pos", {"_before": ("sum", "_n")}).select("ctg", "pos", "_before")
    same_pos = Window.partitionBy("ctg", "pos").orderBy("lib_id", "name", "mate")
    return aln.join(base, ["ctg", "pos"]).withColumn("ord", F.col("_before") + F.row_number().over(same_pos))


def block_order(side: str) -> list[Column]:
    """Contig order of blocks: begin ascending, longer first, then the other side."""
    other = "s" if side == "m" else "m"
    return [
        F.col(f"{side}_begin"),
        F.col(f"{side}_end").desc(),
        F.col(f"{other}_ctg"),
        F.col(f"{other}_begin"),
    ]
