"""Library insert sizes and assembly length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contigloom.operators.reads import has_flag
from contigloom.operators.tiled import exclusive_prefix


def insert_size() -> Column:
    """Query length counts when the read comes first, aligned length otherwise."""
    return F.when(
        F.col("pos") < F.col("mpos"), F.col("mpos") + F.col("len") - F.col("pos")
    ).otherwise(F.col("epos") - F.col("mpos"))


def facing_pair() -> Column:
    """Read and mate point at each other."""
    rev, mrev = has_flag("reverse"), has_flag("mate_reverse")
    return F.when(F.col("pos") < F.col("mpos"), ~rev & mrev).otherwise(rev & ~mrev)


def insert_sizes(good: DataFrame, libraries: DataFrame, require_paired: bool = True) -> DataFrame:
    """(lib_id, isize, n): how often each usable insert of first mates occurs.

    The histogram comes first, so a library holding most reads is combined before
    it meets ``libraries`` (lib_id, min_isize, max_isize; one row per file).
    """
    cond = has_flag("first_mate") & ~has_flag("mate_unmapped") & (F.col("ctg") == F.col("mctg"))
    if require_paired:
        cond = cond & has_flag("paired")
    return (
        good.where(cond & facing_pair())
        .groupBy("lib_id", insert_size().cast("long").alias("isize"))
        .agg(F.count("*").alias("n"))
        .join(libraries, "lib_id")
        .where(F.col("isize").between(F.col("min_isize"), F.col("max_isize")))
    )


def insert_size_stats(good: DataFrame, libraries: DataFrame, require_paired: bool = True) -> DataFrame:
    """Mean and deviation per library; the deviation divides by n + 1."""
    # moments are taken from the smallest insert allowed, to keep the sums small
    d = (F.col("isize") - F.col("min_isize")).cast("double")
    sums = (
        insert_sizes(good, libraries, require_paired)
        .groupBy("lib_id", "min_isize")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * d).alias("d1"), F.sum(F.col("n") * d * d).alias("d2"))
    )
    mean = F.col("d1") / F.col("n")
    spread = F.greatest(F.col("d2") - F.col("d1") * mean, F.lit(0.0))
    return sums.select(
        "lib_id",
        "n",
        (F.col("min_isize") + mean).alias("isize_mean"),
        F.sqrt(spread / (F.col("n") + 1)).alias("isize_std"),
    )


def assembly_stats(lengths: DataFrame) -> DataFrame:
    """Count, total, mean, extremes, half-length contig and its rank, from (length).

    Lengths become a histogram first, so the descending cumulative sum runs
    over distinct lengths in tiles rather than over all contigs in one task.
    """
    hist = (
        lengths.groupBy(F.col("length").cast("long").alias("length"))
        .agg(F.count("*").alias("n"))
        .withColumn("bases", F.col("length") * F.col("n"))
        .withColumn("desc", -F.col("length"))
        .withColumn("one", F.lit(1))
    )
    totals = hist.agg(
        F.sum("n").alias("contigs"),
        F.sum("bases").alias("total"),
        F.max("length").alias("max_len"),
        F.min("length").alias("min_len"),
    )
    run = exclusive_prefix(hist, ["one"], "desc", {"cb": ("sum", "bases"), "cn": ("sum", "n")})
    all_of = F.col("t")  # one row of totals, as a scalar subquery
    half = (
        run.withColumn("t", totals.select(F.struct("*")).scalar())
        .where((2 * F.col("cb") < all_of["total"]) & (2 * (F.col("cb") + F.col("bases")) >= all_of["total"]))
        .select("cb", "cn", "length", "t.*")
    )
    need = F.ceil((F.col("total") - 2 * F.col("cb")) / (2 * F.col("length")))
    return half.select(
        "contigs",
        "total",
        (F.col("total") / F.col("contigs")).alias("avg_len"),
        "max_len",
        "min_len",
        F.col("length").alias("n50_len"),
        (F.col("cn") + need).cast("long").alias("l50_count"),
    )
