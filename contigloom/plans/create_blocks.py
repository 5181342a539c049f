"""Build blocks from the reads of two assemblies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigloom.operators import blocks as bl
from contigloom.operators import coverage, reads, stats
from contigloom.session import cut_lineage
from contigloom.sinks import textfiles as sink


@dataclass
class Created:
    blocks: DataFrame
    master_stats: DataFrame  # lib_id, n, isize_mean, isize_std, reads_len, coverage
    slave_stats: DataFrame


def library_table(aln: DataFrame, libraries: DataFrame, contigs: DataFrame) -> DataFrame:
    """Insert sizes and coverage of every library; a library without inserts keeps 0."""
    good = reads.good_reads(aln)
    size = contigs.agg(F.sum("length").alias("asm_size"))
    sizes = stats.insert_size_stats(good, libraries)
    known = libraries.join(coverage.library_coverage(good, size), "lib_id", "left").join(sizes, "lib_id", "left")
    return known.fillna(0, ["n", "isize_mean", "isize_std", "reads_len", "coverage"])


def create_blocks(
    master: DataFrame,
    slave: DataFrame,
    master_libraries: DataFrame,
    slave_libraries: DataFrame,
    master_contigs: DataFrame,
    slave_contigs: DataFrame,
    min_block_size: int = 50,
    multiplicity_filter: bool = True,
) -> Created:
    """Alignments of the same reads on both assemblies to blocks with frame coverage."""
    m = reads.usable_reads(master, multiplicity_filter)
    s = reads.usable_reads(slave, multiplicity_filter)
    blocks = cut_lineage(bl.build_blocks(reads.read_pairs(m, s), min_block_size))
    return Created(
        bl.with_frame_coverage(blocks, m, s),
        library_table(master, master_libraries, master_contigs),
        library_table(slave, slave_libraries, slave_contigs),
    )


def write(created: Created, prefix: str) -> None:
    """``prefix.blocks`` and the library statistics of both sides."""
    sink.write_blocks(created.blocks, f"{prefix}.blocks")
    sink.write_library_stats(created.master_stats, f"{prefix}.master.isize")
    sink.write_library_stats(created.slave_stats, f"{prefix}.slave.isize")
