"""Length statistics of a FASTA file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigloom.operators.stats import assembly_stats
from contigloom.sources.textfiles import fasta_lengths


def fasta_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of all records; a record with illegal letters is an error."""
    lengths = fasta_lengths(spark, path)
    legal = F.when(F.col("length") >= 0, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("illegal letters in "), F.col("name")))
    )
    return assembly_stats(lengths.select(legal.alias("length")))
