"""Registered queries from files: BAM lists to blocks, appends and regions, FASTA, and the remaining scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigloom.operators import assembly_graph as ag
from contigloom.operators import block_filters as bf
from contigloom.operators import blocks as bl
from contigloom.functions.intervals import minimum_bin
from contigloom.operators import ordering, reads, regions
from contigloom.plans.catalog_blocks import _BLOCK_SQL, _block_cols
from contigloom.plans.catalog_graph import _COMP, _VERTEX
from contigloom.plans.catalog_io import _SEQ
from contigloom.plans.fixture import M_LEN, S_LEN, Tables, oracle
from contigloom.plans.registry import long, query
from contigloom.session import cut_lineage, freed_shuffles, scratch_path
from contigloom.sinks import textfiles as sink
from contigloom.sources import alignments, bam, bam_index, textfiles


def _write(t: Tables, aln: DataFrame, side: str, path: str, mode: str = "append") -> None:
    """Position-sorted BAM files of some alignments."""
    bam.register(t.spark)
    size = M_LEN if side == "m" else S_LEN
    top = t.contigs(side).agg(F.max("ctg_id")).first()[0]
    with freed_shuffles(t.spark):
        (
            _records(aln).write.format("bam").mode(mode)
            .option("header", "@HD\tVN:1.0\tSO:coordinate\n")
            .option("references", ",".join(f"{side}{i}:{size}" for i in range(top + 1))).save(path)
        )


def _records(aln: DataFrame) -> DataFrame:
    """BAM records in order of position; their bases are made after the shuffle, which they would fill."""
    placed = aln.withColumn("ref_id", F.col("ctg").cast("int")).withColumn("pos", F.col("pos").cast("int"))
    narrow = placed.select("name", "flag", "ref_id", "pos", "len", "mctg", "mpos", "nh")
    return narrow.repartitionByRange("ref_id", "pos").sortWithinPartitions("ref_id", "pos").select(
        "name", F.col("flag").cast("int").alias("flag"), "ref_id", "pos", F.lit(60).alias("mapq"), F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar"),
        F.col("mctg").cast("int").alias("mate_ref_id"), F.col("mpos").cast("int").alias("mate_pos"),
        F.expr(_SEQ).alias("seq"), F.col("nh").cast("int").alias("nh"),
    )


def _from_files(t: Tables, side: str) -> tuple[DataFrame, DataFrame]:
    """One BAM folder per library, a list of them, and what comes back: alignments and contigs."""
    base = scratch_path(t.spark, f"bam-{side}")
    with t.short_alignments(side) as aln:
        for lib in (0, 1):
            _write(t, aln.where(F.col("lib_id") == lib), side, f"{base}/lib{lib}")
    lines = t.spark.range(1).select(F.lit(f"{base}/lib0\n90 500\n{base}/lib1\n90 500\n").alias("value"))
    lines.coalesce(1).write.text(f"{base}/list")
    libraries = cut_lineage(textfiles.read_library_list(t.spark, f"{base}/list"))
    alignments.check_libraries(libraries)
    return alignments.read_alignments(t.spark, libraries), alignments.read_contigs(t.spark, libraries)


@query("bam_to_blocks", oracle(f"SELECT {_BLOCK_SQL} FROM blk", "blk"))
def bam_to_blocks(t: Tables):
    """Both assemblies written as BAM, found again by their lists, and made into blocks."""
    m, s = (reads.usable_reads(_from_files(t, side)[0]) for side in ("m", "s"))
    return _block_cols(bl.build_blocks(reads.read_pairs(m, s)))


@query(
    "bam_contigs",
    oracle("SELECT 'm' AS side, ctg_id, name, length FROM cm UNION ALL SELECT 's', ctg_id, name, length FROM cs", "cm", "cs"),
)
def bam_contigs(t: Tables):
    """The reference dictionaries of both sides, equal in all files of a list."""
    m, s = (_from_files(t, side)[1].select(F.lit(side).alias("side"), "ctg_id", "name", "length") for side in ("m", "s"))
    return m.unionByName(s)


@query(
    "bam_append_overwrite",
    oracle(
        """SELECT 'append' AS step, CAST(lib_id AS BIGINT) AS parity, CAST(count(*) AS BIGINT) AS n FROM am GROUP BY lib_id
 UNION ALL SELECT 'overwrite', CAST(lib_id AS BIGINT), CAST(count(*) AS BIGINT) FROM am WHERE lib_id = 1 GROUP BY lib_id""",
        "am",
    ),
)
def bam_append_overwrite(t: Tables):
    """Records by parity of their length after two appends, and after one of them has overwritten both."""
    path = scratch_path(t.spark, "bam-twice")
    odd = t.master.where("lib_id = 1")
    out = None
    for step, modes in (("append", ((t.master.where("lib_id = 0"), "append"), (odd, "append"))), ("overwrite", ((odd, "overwrite"),))):
        for aln, mode in modes:
            _write(t, aln, "m", path, mode)
        back = t.spark.read.format("bam").schema("query_len int").load(path)
        got = cut_lineage(back.groupBy(long(F.col("query_len") % 2).alias("parity")).agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "parity", "n"))
        out = got if out is None else out.unionByName(got)
    return out


@query(
    "bam_region",
    oracle(
        """SELECT name, CAST(flag AS BIGINT) AS flag, CAST(ctg AS BIGINT) AS ref_id, CAST(pos AS BIGINT) AS pos FROM am
 WHERE ctg = 1 AND pos < 4000 AND epos > 2000""",
        "am",
    ),
)
def bam_region(t: Tables):
    """Records of the second contig that overlap [2000, 4000), asked of the reader."""
    path = scratch_path(t.spark, "bam-region")
    _write(t, t.master, "m", path)
    back = t.spark.read.format("bam").schema("name string, flag int, ref_id int, pos int").option("ref", 1).option("begin", 2000).option("end", 4000).load(path)
    return back.select("name", *[long(c).alias(c) for c in ("flag", "ref_id", "pos")])


@query(
    "jump_scan",
    oracle("SELECT name, CAST(mate AS BIGINT) AS mate, CAST(ctg AS BIGINT) AS ctg, CAST(pos AS BIGINT) AS pos FROM am WHERE ctg > 1 OR ctg = 1 AND epos > 5000", "am"),
)
def jump_scan(t: Tables):
    """Everything from a place on, later contigs included."""
    return regions.jump(t.alignments("m"), 1, 5000).select("name", long("mate").alias("mate"), long("ctg").alias("ctg"), long("pos").alias("pos"))


@query(
    "block_overlap_report",
    oracle(
        """SELECT CAST(m_ctg AS BIGINT) AS m_ctg, CAST(m_begin AS BIGINT) AS m_begin, CAST(m_end AS BIGINT) AS m_end, CAST(nb AS BIGINT) AS next_begin, CAST(ne AS BIGINT) AS next_end
 FROM (SELECT *, lead(m_begin) OVER w AS nb, lead(m_end) OVER w AS ne FROM (SELECT * REPLACE (m_end + 300 AS m_end) FROM blk) y
 WINDOW w AS (PARTITION BY m_ctg ORDER BY m_begin, m_end DESC, s_ctg, s_begin)) x
 WHERE 100.0 * greatest(least(m_end, ne) - greatest(m_begin, nb) + 1, 0) / (ne - nb + 1) >= 0.1""",
        "blk",
    ),
)
def block_overlap_report(t: Tables):
    """Neighbouring blocks, drawn out by 300 bases, of which the later is covered by at least a thousandth."""
    near = bf.block_overlaps(t.blocks.withColumn("m_end", F.col("m_end") + 300), "m", 0.1)
    return near.select(
        *[long(c).alias(c) for c in ("m_ctg", "m_begin", "m_end")], long("next_m_begin").alias("next_begin"), long("next_m_end").alias("next_end")
    )


@query(
    "share_contigs",
    oracle(
        """SELECT CAST(m_ctg AS BIGINT) AS m_ctg, CAST(s_ctg AS BIGINT) AS s_ctg, CAST(m_begin AS BIGINT) AS m_begin,
 nm = m_ctg AS share_master, ns = s_ctg AS share_slave, nm = m_ctg OR ns = s_ctg AS share_any
 FROM (SELECT *, lead(m_ctg) OVER w AS nm, lead(s_ctg) OVER w AS ns FROM blk WINDOW w AS (PARTITION BY m_ctg % 7 ORDER BY m_ctg, m_begin, s_ctg, s_begin)) x
 WHERE nm IS NOT NULL""",
        "blk",
    ),
)
def share_contigs(t: Tables):
    """Which contigs a block shares with the next one of its group of master contigs."""
    along = Window.partitionBy(F.col("m_ctg") % 7).orderBy("m_ctg", "m_begin", "s_ctg", "s_begin")
    own = F.struct("m_ctg", "s_ctg")
    near = t.blocks.withColumn("a", own).withColumn("b", F.lead(own).over(along)).where("b IS NOT NULL")
    return near.select(
        *[long(c).alias(c) for c in ("m_ctg", "s_ctg", "m_begin")],
        bf.shares_contig("a", "b", "m").alias("share_master"),
        bf.shares_contig("a", "b", "s").alias("share_slave"),
        bf.shares_contig("a", "b").alias("share_any"),
    )


@query(
    "fasta_roundtrip",
    oracle("SELECT name, CAST(length AS BIGINT) AS counted, sequence FROM qs", "qs"),
)
def fasta_roundtrip(t: Tables):
    """Slave contigs written as FASTA, read back, and their lengths counted from the file."""
    path = scratch_path(t.spark, "fasta")
    sink.write_contigs(t.sequences("s"), path)
    counted = textfiles.fasta_lengths(t.spark, path).select("name", long("length").alias("counted"))
    return textfiles.read_fasta(t.spark, path).join(counted, "name").select("name", "counted", "sequence")


@query(
    "sorted_region_fetch",
    oracle(
        """SELECT CAST(n AS BIGINT) AS n, name, CAST(mate AS BIGINT) AS mate, CAST(pos AS BIGINT) AS pos FROM (
 SELECT *, row_number() OVER (ORDER BY pos, name, mate) AS n FROM am WHERE ctg = 2 AND pos < 6000 AND epos > 5000) x""",
        "am",
    ),
)
def sorted_region_fetch(t: Tables):
    """Reads over a stretch of one contig in order of position."""
    got = ordering.sorted_region(t.alignments("m"), 2, 5000, 6000)
    rank = F.row_number().over(Window.partitionBy("ctg").orderBy("pos", "name", "mate"))  # a stretch of 1000 bases
    return got.select(long(rank).alias("n"), "name", long("mate").alias("mate"), long("pos").alias("pos"))


@query(
    "contig_dot",
    oracle(
        f"""SELECT CAST(component AS BIGINT) AS component, CAST(ord AS BIGINT) AS ord, value FROM (
 SELECT DISTINCT component, 0 AS ord, concat('graph ContigGraph_', component, ' {{') AS value FROM comp UNION ALL
 SELECT component, 1, concat(chr(9), asm, ctg, '[label="', ctg, '"];') FROM (SELECT {_VERTEX}, component FROM comp) v UNION ALL
 SELECT c.component, 2, concat(chr(9), 'm', CAST(u / 2 AS BIGINT), '--s', CAST((v - 1) / 2 AS BIGINT), '[color=black];') FROM lk JOIN comp c ON c.vertex = lk.u UNION ALL
 SELECT DISTINCT component, 3, '}}' FROM comp) x""",
        "b10", extra=_COMP, recursive=True,
    ),
)
def contig_dot(t: Tables):
    """Lines of the contig graphs."""
    pairs = cut_lineage(ag.contig_pairs(t.merge_blocks))
    dot = sink.contig_dot(cut_lineage(ag.contig_components(pairs)), pairs)
    return dot.select(long("component").alias("component"), long("ord").alias("ord"), "value")


@query(
    "bam_unindexed_splits",
    oracle(
        """SELECT name, CAST(flag AS BIGINT) AS flag, CAST(ctg AS BIGINT) AS ref_id, CAST(pos AS BIGINT) AS pos, CAST(epos AS BIGINT) AS epos, CAST(nh AS BIGINT) AS nh FROM am""",
        "am",
    ),
)
def bam_unindexed_splits(t: Tables):
    """Files without an index, read by a task for every 200 kB: the tasks find the records by themselves."""
    path = scratch_path(t.spark, "bam-split")
    _write(t, t.master, "m", path)
    back = t.spark.read.format("bam").schema("name string, flag int, ref_id int, pos int, epos int, nh int").option("splitBytes", 200_000).load(path)
    return back.select("name", *[long(c).alias(c) for c in ("flag", "ref_id", "pos", "epos", "nh")])


#: Bits of a place within one of the references that the genome is cut into.
_REF_BITS = 28
#: Master reads in genome coordinates; some skip 20 to 800 kb, so that their records lie in bins of several levels.
_SPLICED = """SELECT name, flag, nh, ctg * 10000 + pos AS pos, len, CASE WHEN pos % 97 = 0 THEN 800000 WHEN pos % 89 = 0 THEN 150000 WHEN pos % 83 = 0 THEN 20000 ELSE 0 END AS skip FROM {aln}"""
_SPLICED_CTE = f"sp AS (SELECT *, pos + len + skip + CASE WHEN skip > 0 THEN 1 ELSE 0 END AS epos FROM ({_SPLICED.format(aln='am')}) q)"


def _spliced(t: Tables):
    """Position-sorted, indexed BAM files of the spliced reads: their folder, and how many references they name.

    An index numbers 2^29 positions of a reference.  The genome is cut into
    references of half of that, and reads may reach beyond the cut.
    """
    bam.register(t.spark)
    path = scratch_path(t.spark, "bam-bins")
    aln = t.spark.sql(_SPLICED, aln=t.master)
    cigar = F.when(F.col("skip") > 0, F.concat(F.col("len").cast("string"), F.lit("M"), F.col("skip").cast("string"), F.lit("N1M")))
    records = aln.select(
        "name", F.col("flag").cast("int").alias("flag"), F.shiftright("pos", _REF_BITS).cast("int").alias("ref_id"),
        F.col("pos").bitwiseAND(F.lit((1 << _REF_BITS) - 1)).cast("int").alias("pos"),
        F.coalesce(cigar, F.concat(F.col("len").cast("string"), F.lit("M"))).alias("cigar"), F.lit(-1).alias("mate_ref_id"), F.lit(-1).alias("mate_pos"),
    )
    top = aln.agg(F.max(F.shiftright("pos", _REF_BITS))).first()[0]
    n_refs = 1 + (top or 0)
    sorted_ = records.repartitionByRange("ref_id", "pos").sortWithinPartitions("ref_id", "pos")
    sorted_.write.format("bam").mode("append").option("references", ",".join(f"g{i}:{1 << 29}" for i in range(n_refs))).save(path)
    back = t.spark.read.format("bam").schema("path string, rec_no long, ref_id int, pos int, epos int").load(path)
    bam_index.index_files(back, back.select("path").distinct().withColumn("n", F.lit(n_refs))).write.format("noop").mode("overwrite").save()
    return path, n_refs


def _in_genome(column: str) -> Column:
    """A place of a reference as a place of the genome."""
    return F.shiftleft(long("ref_id"), _REF_BITS) + F.col(column)


@query(
    "bam_bin_levels",
    oracle(
        """SELECT bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(CASE WHEN pos >> 14 = (epos - 1) >> 14 THEN 4681 + (pos >> 14) WHEN pos >> 17 = (epos - 1) >> 17 THEN 585 + (pos >> 17)
 WHEN pos >> 20 = (epos - 1) >> 20 THEN 73 + (pos >> 20) WHEN pos >> 23 = (epos - 1) >> 23 THEN 9 + (pos >> 23) ELSE 1 + (pos >> 26) END AS BIGINT) AS bin FROM sp) x GROUP BY bin""",
        "am", extra=_SPLICED_CTE,
    ),
)
def bam_bin_levels(t: Tables):
    """Records per bin of several levels, read through the chunks of the written index."""
    path, n_refs = _spliced(t)
    reader = t.spark.read.format("bam").schema("ref_id int, pos int, epos int")
    back = reduce(DataFrame.unionByName, [reader.option("ref", i).load(path) for i in range(n_refs)])
    return back.groupBy(minimum_bin(_in_genome("pos"), _in_genome("epos")).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "bam_indexed_region",
    oracle("SELECT name, CAST(flag AS BIGINT) AS flag, pos, epos FROM sp WHERE pos < 140000 AND epos > 120000", "am", extra=_SPLICED_CTE),
)
def bam_indexed_region(t: Tables):
    """A region by its bins' chunks: reads that lie in it and reads that only reach into it."""
    path, _ = _spliced(t)
    reader = t.spark.read.format("bam").option("ref", 0).option("begin", 120_000).option("end", 140_000)
    back = reader.schema("name string, flag int, ref_id int, pos int, epos int").load(path)
    return back.select("name", long("flag").alias("flag"), *[_in_genome(c).alias(c) for c in ("pos", "epos")])


@query(
    "multi_bam_region",
    oracle(
        """SELECT name, CAST(mate AS BIGINT) AS mate, CAST(lib_id AS BIGINT) AS lib_id, CAST(ctg AS BIGINT) AS ctg, CAST(pos AS BIGINT) AS pos FROM am
 WHERE ctg = 2 AND pos < 7000 AND epos > 1000""",
        "am",
    ),
)
def multi_bam_region(t: Tables):
    """A region asked of all libraries of a list at once."""
    base = scratch_path(t.spark, "bam-libs")
    for lib in (0, 1):
        _write(t, t.master.where(F.col("lib_id") == lib), "m", f"{base}/lib{lib}")
    libraries = t.spark.range(2).select(F.col("id").cast("int").alias("lib_id"), F.concat(F.lit(f"{base}/lib"), F.col("id").cast("string")).alias("path"))
    found = alignments.read_alignments(t.spark, libraries, (2, 1000, 7000))
    return found.select("name", *[long(c).alias(c) for c in ("mate", "lib_id", "ctg", "pos")])
