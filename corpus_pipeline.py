"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of their input.  Rows with null or empty text are judged like any
text; rows without id stay through the stages that link rows by id.  Stages
accept extra columns and pass them through (the last replaces ``mix_...``).
Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigloom.llm import decontaminate, mixing, near_dedup, pii, quality
from contigloom.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS
from contigloom.llm.shared import stored, table

LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches LEAST_QUALITY; learnt from the labels of these documents."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.scores(docs, model).where(F.col("_score") >= LEAST_QUALITY).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id, once."""
    found = near_dedup.near_duplicates(docs, words=5, similarity=80)
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    with_id = docs.join(kept, docs["doc_id"].cast("long") == F.col("_kept"), "left_semi")
    return with_id.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.without_overlaps(docs, decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars, where it is a column, counts anew."""
    clean = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how often each is taken."""
    return mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", redact),
    ("mix", mix_sources),
]

#: The quality and personal-data stages are fitted models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), "stage-mix")
