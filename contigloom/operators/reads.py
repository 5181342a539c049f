"""Read filters and the read-pair join.

Alignment frames carry: name, mate, ctg, pos, epos (half open), rev, nh, xt,
flag, len, lib_id, mctg, mpos.  Only the columns an operator names are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# SAM flag bits.
FLAG_BITS = {
    "paired": 0x1,
    "proper_pair": 0x2,
    "unmapped": 0x4,
    "mate_unmapped": 0x8,
    "reverse": 0x10,
    "mate_reverse": 0x20,
    "first_mate": 0x40,
    "second_mate": 0x80,
    "secondary": 0x100,
    "failed_qc": 0x200,
    "duplicate": 0x400,
}
# unmapped + secondary + failed QC + duplicate
REJECT_MASK = 0x704


def has_flag(name: str, flag: Column | str = "flag") -> Column:
    col = F.col(flag) if isinstance(flag, str) else flag
    return col.bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def set_flag(name: str, on: bool, flag: Column | str = "flag") -> Column:
    col = F.col(flag) if isinstance(flag, str) else flag
    bit = FLAG_BITS[name]
    return col.bitwiseOR(F.lit(bit)) if on else col.bitwiseAND(F.lit(~bit))


def good_reads(aln: DataFrame) -> DataFrame:
    """Mapped, primary, not duplicate, not QC-failed (supplementary passes)."""
    return aln.where((F.col("flag").bitwiseAND(F.lit(REJECT_MASK)) == 0) & (F.col("pos") >= 0))


def unique_reads(aln: DataFrame, multiplicity_filter: bool = True) -> DataFrame:
    """Keep NH = 1 and XT = 'U'; a missing tag counts as unique."""
    if not multiplicity_filter:
        return aln
    cond = F.coalesce("nh", F.lit(1)) == 1
    if "xt" in aln.columns:
        cond = cond & (F.coalesce("xt", F.lit("U")) == "U")
    return aln.where(cond)


def usable_reads(aln: DataFrame, multiplicity_filter: bool = True) -> DataFrame:
    return unique_reads(good_reads(aln), multiplicity_filter)


def read_pairs(
    master: DataFrame, slave: DataFrame, scan_order: Sequence[str] = ("ctg", "pos", "lib_id")
) -> DataFrame:
    """Join slave alignments to the master alignment of the same (name, mate).

    Of several master alignments the last in scan order wins; it is chosen by
    an aggregate, so a repeated name collapses before the shuffle.  The slave
    side keeps its repeats, and AQE may split them (the master side is unique).
    """
    # one struct is both the order and what is taken, so that each column travels once
    fields = dict.fromkeys([*scan_order, "epos", "rev", "ctg", "pos"])
    build = master.groupBy("name", "mate").agg(F.max(F.struct(*fields)).alias("m"))
    return slave.join(build, ["name", "mate"]).select(
        F.col("m.ctg").alias("m_ctg"),
        F.col("ctg").alias("s_ctg"),
        F.col("m.pos").alias("m_start"),
        (F.col("m.epos") - 1).alias("m_last"),
        F.col("pos").alias("s_start"),
        (F.col("epos") - 1).alias("s_last"),
        "name",
        "mate",
        (F.col("m.rev") == F.col("rev")).alias("concordant"),
    )


def union_libraries(*alns: DataFrame) -> DataFrame:
    """Multi-library scan: a union by name; order it only where order matters."""
    out = alns[0]
    for other in alns[1:]:
        out = out.unionByName(other)
    return out
