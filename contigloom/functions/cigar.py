"""CIGAR expressions over ``array<struct<op:string,len:int>>``, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_cigar(text: Column) -> Column:
    """``'5S10M'`` to an array of (op, len)."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.substring(p, -1, 1).alias("op"),
            F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("len"),
        ),
    )


def reference_span(cigar: Column, padded: bool = False) -> Column:
    """Bases the alignment covers on the contig; padded also counts insertions."""
    ops = ["M", "D", "N", "=", "X"] + (["I"] if padded else [])
    return F.aggregate(
        F.filter(cigar, lambda c: c["op"].isin(ops)), F.lit(0), lambda acc, c: acc + c["len"]
    )


def end_position(pos: Column, cigar: Column, padded: bool = False, closed: bool = False) -> Column:
    end = pos + reference_span(cigar, padded)
    return end - 1 if closed else end


def soft_clips(pos: Column, cigar: Column, skip_deletions: bool = False, padded: bool = False) -> Column:
    """Array of (size, read_pos, genome_pos), one per soft clip.

    A clip that opens the CIGAR is reported past its own bases, at the position
    of the first aligned base.  Deletions and skips advance the read position
    too, unless ``skip_deletions`` asks for true read coordinates.
    """
    read_ops = ["M", "=", "X", "I"] + ([] if skip_deletions else ["D", "N"])
    genome_ops = ["M", "=", "X", "D", "N"] + (["I"] if padded else [])
    state = F.struct(
        F.lit(0).cast("long").alias("r"),
        pos.cast("long").alias("g"),
        F.lit(True).alias("opening"),
        F.array().cast("array<struct<size:int,read_pos:bigint,genome_pos:bigint>>").alias("out"),
    )

    def step(acc: Column, c: Column) -> Column:
        n, op = c["len"], c["op"]
        clip = op == "S"
        read_at = acc["r"] + F.when(op.isin(read_ops) | (clip & acc["opening"]), n).otherwise(0)
        hit = F.struct(n.alias("size"), read_at.alias("read_pos"), acc["g"].alias("genome_pos"))
        return F.struct(
            read_at.alias("r"),
            (acc["g"] + F.when(op.isin(genome_ops), n).otherwise(0)).alias("g"),
            F.lit(False).alias("opening"),
            F.when(clip, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(cigar, state, step, lambda acc: acc["out"])


def aligned_bases(seq: Column, cigar: Column) -> Column:
    """Read bases along the alignment: D as '-', P as '*', N as 'N', clips dropped."""
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("s"))

    def step(acc: Column, c: Column) -> Column:
        n, op = c["len"], c["op"]
        piece = (
            F.when(op.isin("M", "I", "=", "X"), F.substring(seq, acc["at"], n))
            .when(op == "D", F.repeat(F.lit("-"), n))
            .when(op == "P", F.repeat(F.lit("*"), n))
            .when(op == "N", F.repeat(F.lit("N"), n))
            .otherwise("")
        )
        return F.struct(
            (acc["at"] + F.when(op.isin("M", "I", "=", "X", "S"), n).otherwise(0)).alias("at"),
            F.concat(acc["s"], piece).alias("s"),
        )

    return F.aggregate(cigar, state, step, lambda acc: acc["s"])
