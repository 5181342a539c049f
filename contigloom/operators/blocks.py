"""Block building: 2-D sessionization of read pairs.

Pairs (m_ctg, s_ctg, m_start, m_last, s_start, s_last, concordant) are read in
slave order.  The first open block whose master and slave frames both touch a
pair absorbs it, otherwise the pair opens a new block.
"""

from __future__ import annotations

from contextlib import AbstractContextManager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigloom.operators.tiled import exclusive_prefix, island_starts
from contigloom.session import cut_lineage, result_only, short_lived
from contigloom.streaming.ordered_blocks import BLOCK_SCHEMA, stream_blocks

PAIR = ["m_ctg", "s_ctg"]
COORDS = ["s_start", "s_last", "m_start", "m_last"]
BLOCK_COLUMNS = [
    "m_ctg", "s_ctg", "num_reads", "m_begin", "m_end", "s_begin", "s_end",
    "m_block_reads_len", "s_block_reads_len", "s_strand",
]


def collapse_pairs(pairs: DataFrame) -> DataFrame:
    """One row per distinct placement, with its read count.

    Copies of a placement always end in the same block, so the copies can be
    counted before anything is shuffled or sorted.
    """
    return pairs.groupBy(*PAIR, *[F.col(c).cast("long").alias(c) for c in COORDS]).agg(
        F.count("*").alias("n"), F.sum(F.col("concordant").cast("long")).alias("n_conc")
    )


def _label_islands(placements: DataFrame, keys: list[str], axis: str, out: str) -> DataFrame:
    """Label placements with their 1-D island along one axis."""
    start, last = f"{axis}_start", f"{axis}_last"
    per_start = placements.groupBy(*keys, start).agg(F.max(last).alias("_hi"))
    labels = island_starts(per_start, keys, start, "_hi", out).select(*keys, start, out)
    return placements.join(labels, [*keys, start])


def _starts(placements: DataFrame, keys: list[str]) -> DataFrame:
    """One row per slave start of ``keys``, with all that blocks and their check take from its placements.

    A slave island is told by the start alone, so labels need no join back to the
    placements.  Of equal placements a concordant one comes first.
    """
    # in this order equal numbers mostly stand in the same sequence again, which shuffles compress
    return placements.groupBy(*keys, "s_start").agg(
        F.max("s_last").alias("s_last"),
        F.min("m_start").alias("lo"),
        F.max("m_last").alias("hi"),
        F.max("m_start").alias("late_start"),
        F.min("m_last").alias("first_end"),
        F.sum(F.col("n") * (F.col("m_last") - F.col("m_start") + 1)).alias("m_len"),
        F.sum(F.col("n") * (F.col("s_last") - F.col("s_start") + 1)).alias("s_len"),
        F.sum("n").alias("n"),
        F.sum("n_conc").alias("n_conc"),
        F.min(F.struct(*COORDS[1:], (F.col("n_conc") == 0).alias("against"))).alias("seed"),
    ).withColumn("seed", F.when(F.col("seed.against"), 0).otherwise(1))


def _single_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs as placements of one read each; their starts combine the copies before any shuffle."""
    return pairs.select(
        *PAIR, *[F.col(c).cast("long").alias(c) for c in COORDS],
        F.lit(1).cast("long").alias("n"), F.col("concordant").cast("long").alias("n_conc"),
    )


def _summarise(starts: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks from cells known to be single blocks; the seed pair does not vote."""
    seed_conc = F.min_by("seed", "s_start")
    n, conc = F.sum("n"), F.sum("n_conc")
    votes_with = conc - seed_conc
    votes_against = (n - conc) - (1 - seed_conc)
    return starts.groupBy(*keys).agg(
        n.alias("num_reads"),
        F.min("lo").alias("m_begin"),
        F.max("hi").alias("m_end"),
        F.min("s_start").alias("s_begin"),
        F.max("s_last").alias("s_end"),
        F.sum("m_len").alias("m_block_reads_len"),
        F.sum("s_len").alias("s_block_reads_len"),
        F.when(votes_with >= votes_against, "+").otherwise("-").alias("s_strand"),
    )


def _joined(pairs: DataFrame) -> AbstractContextManager[DataFrame]:
    """Pairs as a passing table: the shuffles of their join are freed before those of the blocks fill."""
    return short_lived(pairs.select(*PAIR, *COORDS, "concordant"))


def blocks_by_islands(pairs: DataFrame, min_reads: int = 1) -> DataFrame:
    """Blocks as slave-axis islands: exact when both axes run collinear."""

    def blocks() -> DataFrame:
        # without what only the check of tangled cells reads
        rows = _starts(_single_pairs(pairs), PAIR).drop("first_end", "late_start")
        starts = island_starts(rows, PAIR, "s_start", "s_last", "cell")
        return _summarise(starts, [*PAIR, "cell"])

    with _joined(pairs) as pairs:
        return result_only(blocks).where(F.col("num_reads") >= min_reads).select(*BLOCK_COLUMNS)


def _collinear_cells(starts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of cells in which every pair touches the hull of the pairs before it.

    Such a cell is one block whatever the order of ties: the check compares the
    extreme master coordinates at each slave start with the hull built from
    smaller starts (slave frames touch because a cell is a slave island).
    """
    per_start = starts.select(*keys, "s_start", "lo", "hi", "first_end", "late_start")
    run = exclusive_prefix(
        per_start, keys, "s_start", {"hull_lo": ("min", "lo"), "hull_hi": ("max", "hi")}
    )
    touches = F.when(
        F.col("hull_lo").isNull(), F.col("late_start") <= F.col("first_end") + 1
    ).otherwise(
        (F.col("first_end") >= F.col("hull_lo") - 1) & (F.col("late_start") <= F.col("hull_hi") + 1)
    )
    return run.groupBy(*keys).agg(F.bool_and(touches).alias("single"))


def _settle(placements: DataFrame, keys: list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the slave islands of ``keys`` that are proved single, and the starts of the others with their island."""
    starts = island_starts(_starts(placements, keys), keys, "s_start", "s_last", out)
    cells = [*keys, out]
    single = cut_lineage(_collinear_cells(starts, cells))
    blocks = _summarise(starts, cells).join(single.where("single"), cells, "left_semi")
    tangled = starts.select(*cells, "s_start").join(single.where("not single"), cells, "left_semi")
    return blocks.select(*BLOCK_COLUMNS), cut_lineage(tangled)


def build_blocks(pairs: DataFrame, min_reads: int = 1) -> DataFrame:
    """Exact blocks for any input.

    No block crosses an island of either axis.  Pairs are cut into slave islands;
    what is not proved a single block there is cut into master islands within
    them, then slave islands again.  Only the tangled rest goes through the
    ordered pass, which streams a cell and holds its open blocks.
    """
    with _joined(pairs) as pairs:
        return _build(pairs).where(F.col("num_reads") >= min_reads)


def _build(pairs: DataFrame) -> DataFrame:
    """The blocks of stored pairs, which only stored tables are made from."""
    blocks, tangled = _settle(_single_pairs(pairs), PAIR, "c1")
    if not tangled.isEmpty():
        rest = cut_lineage(collapse_pairs(pairs).join(tangled, [*PAIR, "s_start"]))
        keys = [*PAIR, "c1", "c2", "c3"]
        cells = cut_lineage(_label_islands(rest, keys[:-2], "m", "c2"))
        more, tangled = _settle(cells, keys[:-1], "c3")
        tangled = cells.join(tangled, [*keys[:-1], "s_start"])
        streamed = (
            tangled.select(*keys, *COORDS, "n", "n_conc")
            .repartition(*keys)
            .sortWithinPartitions(*keys, *COORDS)
            .groupBy(*keys)
            .applyInPandas(stream_blocks, BLOCK_SCHEMA)
        )
        blocks = blocks.unionByName(more).unionByName(streamed)
    return blocks


def with_frame_coverage(blocks: DataFrame, master_reads: DataFrame, slave_reads: DataFrame) -> DataFrame:
    """Add m_reads_len / s_reads_len: all unique reads over each frame."""
    from contigloom.operators.coverage import frame_reads_length

    out = blocks
    for side, reads in (("m", master_reads), ("s", slave_reads)):
        frames = blocks.select(
            F.col(f"{side}_ctg").alias("ctg"),
            F.col(f"{side}_begin").alias("begin"),
            F.col(f"{side}_end").alias("end"),
        ).distinct()
        total = frame_reads_length(frames, reads, ["ctg", "begin", "end"]).select(
            F.col("ctg").alias(f"{side}_ctg"),
            F.col("begin").alias(f"{side}_begin"),
            F.col("end").alias(f"{side}_end"),
            F.col("reads_len").alias(f"{side}_reads_len"),
        )
        out = out.join(total, [f"{side}_ctg", f"{side}_begin", f"{side}_end"])
    return out
