"""Nucleotide expressions on strings over ACGTN."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def normalise(seq: Column) -> Column:
    """Upper case; anything but A, C, G, T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def chop_begin(seq: Column, start: Column) -> Column:
    """From 0-based ``start`` to the end."""
    return F.substring(seq, start + 1, F.length(seq))


def chop_end(seq: Column, end: Column) -> Column:
    """Up to and including 0-based ``end``."""
    return F.substring(seq, F.lit(1), end + 1)


def chop_borders(seq: Column, start: Column, end: Column) -> Column:
    return F.substring(seq, start + 1, end - start + 1)


def bases_match(a: Column, b: Column) -> Column:
    """Equal, or either is N."""
    return (a == b) | (a == "N") | (b == "N")


def fasta_lines(seq: Column, width: int = 60) -> Column:
    """Sequence as an array of lines of ``width`` bases, cut in one pass."""
    return F.regexp_extract_all(seq, F.lit(rf"(.{{1,{width}}})"), F.lit(1))


def valid_letters(line: Column) -> Column:
    return line.rlike("^[A-Za-z]*$")


def register(spark: SparkSession) -> None:
    """SQL functions for users of the SQL interface."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING "
        "RETURN reverse(translate(s, 'ACGT', 'TGCA'))"
    )
