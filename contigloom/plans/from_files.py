"""Both plans from files to files: lists of BAM files, FASTA, blocks and library statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contigloom.plans import create_blocks, merge_assemblies
from contigloom.session import cut_lineage
from contigloom.sources import alignments, textfiles


def _libraries(spark: SparkSession, path: str) -> DataFrame:
    libraries = cut_lineage(textfiles.read_library_list(spark, path))
    alignments.check_libraries(libraries)
    return libraries


def create(spark: SparkSession, master_list: str, slave_list: str, prefix: str, min_block_size: int = 50, multiplicity_filter: bool = True) -> create_blocks.Created:
    """Blocks of the reads that both lists align, and the statistics of their libraries, written under ``prefix``."""
    sides = []
    for path in (master_list, slave_list):
        libraries = _libraries(spark, path)
        sides.append((cut_lineage(alignments.read_alignments(spark, libraries)), libraries, alignments.read_contigs(spark, libraries)))
    (m, m_libs, m_contigs), (s, s_libs, s_contigs) = sides
    made = create_blocks.create_blocks(m, s, m_libs, s_libs, m_contigs, s_contigs, min_block_size, multiplicity_filter)
    create_blocks.write(made, prefix)
    return made


def assembly(spark: SparkSession, library_list: str, statistics: str, fasta: str) -> merge_assemblies.Assembly:
    """One side of a merge; the FASTA file must have the contigs of the BAM headers."""
    libraries = _libraries(spark, library_list)
    sequences = cut_lineage(textfiles.read_fasta(spark, fasta))
    contigs = alignments.read_contigs(spark, libraries, sequences)
    return merge_assemblies.Assembly(
        cut_lineage(alignments.read_alignments(spark, libraries)),
        cut_lineage(textfiles.attach_sequences(contigs, sequences)),
        cut_lineage(textfiles.read_library_stats(spark, statistics, libraries)),
    )


def merge(
    blocks: str, master: merge_assemblies.Assembly, slave: merge_assemblies.Assembly, prefix: str, min_reads: int = 50, coverage_ratio: float = 0.75
) -> merge_assemblies.Merged:
    """Merge along the blocks of a file and write the results under ``prefix``."""
    spark = master.aln.sparkSession
    before = cut_lineage(textfiles.read_blocks(spark, blocks, min_reads))
    kept = merge_assemblies.filter_by_libraries(before, min_reads, coverage_ratio, master.stats, slave.stats)
    result = merge_assemblies.merge(before, kept, master, slave)
    merge_assemblies.write(result, master, slave, prefix)
    return result
