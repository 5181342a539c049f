"""Interval expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flip(begin: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """Inclusive interval seen from the reverse-complemented contig."""
    return size - end - 1, size - begin - 1


def overlap_length(a_start: Column, a_last: Column, b_start: Column, b_last: Column) -> Column:
    return F.greatest(F.least(a_last, b_last) - F.greatest(a_start, b_start) + 1, F.lit(0))


def minimum_bin(begin: Column, end: Column) -> Column:
    """Smallest index bin holding the half-open interval (levels of 14 to 29 bits)."""
    last = end - 1
    expr = None
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        same = F.shiftright(begin, shift) == F.shiftright(last, shift)
        value = F.lit(first) + F.shiftright(begin, shift)
        expr = F.when(same, value) if expr is None else expr.when(same, value)
    return expr.otherwise(F.lit(0)).cast("long")


def candidate_bins(begin: Column, end: Column) -> Column:
    """All index bins that may hold an alignment overlapping the interval."""
    last = end - 1
    parts = [F.array(F.lit(0).cast("long"))]
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        parts.append(
            F.sequence(
                (F.lit(first) + F.shiftright(begin, shift)).cast("long"),
                (F.lit(first) + F.shiftright(last, shift)).cast("long"),
            )
        )
    return F.concat(*parts)
