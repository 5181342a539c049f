"""Registered queries on formats: SAM headers, BAM, blocks, library statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from contigloom.operators import coverage
from contigloom.operators.reads import good_reads, usable_reads
from contigloom.plans.fixture import Tables, oracle
from contigloom.plans.registry import long, query
from contigloom.session import cut_lineage, scratch_path
from contigloom.sinks import textfiles as sink
from contigloom.sources import bam, bam_index, sam_header, textfiles

# Header text of the slave assembly, with some faults in it.
_HEADER_SQL = """SELECT CAST(1 AS BIGINT) AS line_no, concat('@HD', chr(9), 'VN:1.x', chr(9), 'SO:coordinate') AS line
 UNION ALL SELECT 2 + ctg_id, concat('@SQ', chr(9), 'SN:', CASE WHEN ctg_id % 5 = 4 THEN 's0' ELSE name END, chr(9), 'LN:',
 CAST(CASE WHEN ctg_id % 7 = 3 THEN 0 ELSE length END AS STRING)) FROM {contigs}
 UNION ALL SELECT 1000000000 + ctg_id, concat('@RG', chr(9), 'ID:', 'g', CAST(ctg_id % 9 AS STRING), chr(9), 'PL:',
 CASE WHEN ctg_id % 2 = 0 THEN 'illumina' ELSE 'abacus' END) FROM {contigs}
 UNION ALL SELECT 2000000000 + ctg_id, concat('@PG', chr(9), 'ID:p', CAST(ctg_id AS STRING), chr(9), 'PP:p', CAST(ctg_id + 1 AS STRING)) FROM {contigs}
 UNION ALL SELECT 3000000000 + ctg_id, concat('@CO', chr(9), 'contig ', name) FROM {contigs}"""


def _header(t: Tables):
    return t.spark.sql(_HEADER_SQL, contigs=t.contigs("s"))


@query(
    "sam_header_parse",
    oracle(
        """SELECT line_no, substring(line, 2, 2) AS rec, CASE WHEN substring(line, 2, 2) = 'CO' THEN '' ELSE substring(f, 1, 2) END AS key,
 CASE WHEN substring(line, 2, 2) = 'CO' THEN substring(line, 5) ELSE substring(f, 4) END AS value FROM (
 SELECT line_no, line, unnest(string_split(substring(line, 5), chr(9))) AS f FROM hdr) x""",
        "cs", extra=f"hdr AS ({_HEADER_SQL.format(contigs='cs')})",
    ),
)
def sam_header_parse(t: Tables):
    return sam_header.long_form(sam_header.parse(_header(t)))


@query(
    "sam_header_validate",
    oracle(
        """SELECT line_no, issue FROM (SELECT line_no, 'version' AS issue FROM hdr WHERE line_no = 1
 UNION ALL SELECT 2 + ctg_id, 'sequence length' FROM cs WHERE ctg_id % 7 = 3
 UNION ALL SELECT 2 + ctg_id, 'repeated sequence name' FROM cs WHERE ctg_id % 5 = 4
 UNION ALL SELECT 1000000000 + ctg_id, 'repeated read group id' FROM cs WHERE ctg_id >= 9
 UNION ALL SELECT 1000000000 + ctg_id, 'platform' FROM cs WHERE ctg_id % 2 = 1
 UNION ALL SELECT 2000000000 + max(ctg_id), 'unknown previous program' FROM cs) x""",
        "cs", extra=f"hdr AS ({_HEADER_SQL.format(contigs='cs')})",
    ),
)
def sam_header_validate(t: Tables):
    return sam_header.validate(cut_lineage(sam_header.parse(_header(t))))


@query(
    "header_merge",
    oracle(
        """SELECT line_no, line FROM hdr UNION ALL SELECT 5000000000 + min(ctg_id), concat('@RG', chr(9), 'ID:n', CAST(ctg_id % 4 AS STRING)) FROM cm GROUP BY ctg_id % 4""",
        "cs", "cm", extra=f"hdr AS ({_HEADER_SQL.format(contigs='cs')})",
    ),
)
def header_merge(t: Tables):
    """Printed header of two files: the second brings new read groups, some repeated."""
    other = t.contigs("m").select(
        (F.lit(5000000000) + F.col("ctg_id")).alias("line_no"),
        F.concat(F.lit("@RG\tID:n"), (F.col("ctg_id") % 4).cast("string")).alias("line"),
    )
    first = sam_header.parse(_header(t)).withColumn("file_no", F.lit(0))
    both = first.unionByName(sam_header.parse(other).withColumn("file_no", F.lit(1)))
    return sam_header.print_lines(sam_header.merge(cut_lineage(both)))


_BLOCK_SQL = """m_ctg, s_ctg, CAST(num_reads AS BIGINT) AS num_reads, CAST(m_begin AS BIGINT) AS m_begin, CAST(m_end AS BIGINT) AS m_end,
 CAST(s_begin AS BIGINT) AS s_begin, CAST(s_end AS BIGINT) AS s_end, s_strand"""


@query("blocks_roundtrip", oracle(f"SELECT {_BLOCK_SQL} FROM blk WHERE num_reads >= 50", "blk"))
def blocks_roundtrip(t: Tables):
    """Write the blocks table as text and read it back with the size filter."""
    path = scratch_path(t.spark, "blocks")
    blocks = t.blocks.withColumn("m_reads_len", F.col("m_block_reads_len")).withColumn("s_reads_len", F.col("s_block_reads_len"))
    sink.write_blocks(blocks, path)
    back = textfiles.read_blocks(t.spark, path, 50)
    return back.select("m_ctg", "s_ctg", "num_reads", "m_begin", "m_end", "s_begin", "s_end", "s_strand")


@query(
    "isize_roundtrip",
    oracle(
        """SELECT CAST(l.lib_id AS BIGINT) AS lib_id, round(mu, 6) AS isize_mean, round(sd, 6) AS isize_std, round(c, 6) AS coverage FROM libs l JOIN (
 SELECT lib_id, sum(epos - pos) / (SELECT sum(length) FROM cm) AS c FROM am WHERE (flag & 1796) = 0 GROUP BY lib_id) q ON q.lib_id = l.lib_id""",
        "libs", "am", "cm",
    ),
)
def isize_roundtrip(t: Tables):
    """Write the library statistics as text and read them back."""
    path = scratch_path(t.spark, "isize")
    size = t.contigs("m").agg(F.sum("length").alias("asm_size"))
    cov = coverage.library_coverage(good_reads(t.master), size)
    named = t.library_stats("m").join(cov, "lib_id").withColumn("path", F.concat(F.lit("lib"), F.col("lib_id").cast("string")))
    sink.write_library_stats(named, path)
    libs = t.libraries().withColumn("path", F.concat(F.lit("lib"), F.col("lib_id").cast("string")))
    back = textfiles.read_library_stats(t.spark, path, libs)
    return back.select(long("lib_id").alias("lib_id"), *[F.round(c, 6).alias(c) for c in ("isize_mean", "isize_std", "coverage")])


_SEQ = """substring(translate(concat(md5(name), md5(concat(name, 'a')), md5(concat(name, 'b')), md5(concat(name, 'c'))),
 '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, len)"""


def _bam(t: Tables) -> str:
    """Write the master alignments as position-sorted BAM files."""
    bam.register(t.spark)
    path = scratch_path(t.spark, "bam")
    records = t.master.select(
        "name", F.col("flag").cast("int").alias("flag"), F.col("ctg").cast("int").alias("ref_id"), F.col("pos").cast("int").alias("pos"),
        F.lit(60).alias("mapq"), F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar"),
        F.col("mctg").cast("int").alias("mate_ref_id"), F.col("mpos").cast("int").alias("mate_pos"), F.lit(0).alias("tlen"),
        F.expr(_SEQ).alias("seq"), F.col("nh").cast("int").alias("nh"), F.lit("U").alias("xt"),
    )
    refs = t.contigs("m").agg(F.max("ctg_id")).first()[0] + 1
    header = "@HD\tVN:1.0\tSO:coordinate\n"
    (
        records.repartitionByRange("ref_id", "pos").sortWithinPartitions("ref_id", "pos")
        .write.format("bam").mode("append").option("header", header)
        .option("references", ",".join(f"m{i}:10000" for i in range(refs))).save(path)
    )
    return path


@query(
    "bam_roundtrip",
    oracle(
        f"""SELECT name, CAST(flag AS BIGINT) AS flag, CAST(ctg AS BIGINT) AS ref_id, CAST(pos AS BIGINT) AS pos, CAST(epos AS BIGINT) AS epos,
 concat(CAST(len AS STRING), 'M') AS cigar, CAST(mctg AS BIGINT) AS mate_ref_id, CAST(mpos AS BIGINT) AS mate_pos, {_SEQ} AS seq,
 CAST(nh AS BIGINT) AS nh, 'U' AS xt FROM am""",
        "am",
    ),
)
def bam_roundtrip(t: Tables):
    back = t.spark.read.format("bam").schema(
        "name string, flag int, ref_id int, pos int, epos int, cigar string, mate_ref_id int, mate_pos int, seq string, nh int, xt string"
    ).load(_bam(t))
    ints = {"flag", "ref_id", "pos", "epos", "mate_ref_id", "mate_pos", "nh"}
    return back.select(*[long(c).alias(c) if c in ints else c for c in back.columns])


@query(
    "bam_bin_index",
    oracle(
        """SELECT CAST(ctg AS BIGINT) AS ref_id, CAST(4681 AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM am GROUP BY ctg""", "am"
    ),
)
def bam_bin_index(t: Tables):
    """Records per reference and bin, read from the files (every contig fits the first bin)."""
    records = t.spark.read.format("bam").schema("path string, rec_no long, ref_id int, pos int, epos int").load(_bam(t))
    return (
        bam_index.bin_index(records).groupBy(long("ref_id").alias("ref_id"), "bin").agg(F.sum("n").alias("n"))
    )


@query(
    "verbose_blocks",
    oracle(
        """SELECT concat(CAST(num_reads AS STRING), chr(9), 'm', CAST(m_ctg AS STRING), chr(9), '+', chr(9), CAST(m_begin AS STRING), chr(9),
 CAST(m_end AS STRING), chr(9), CAST(x AS STRING), chr(9), 's', CAST(s_ctg AS STRING), chr(9), s_strand, chr(9), CAST(s_begin AS STRING), chr(9),
 CAST(s_end AS STRING), chr(9), CAST(x AS STRING)) AS value FROM (SELECT *, CAST(floor((m_block_reads_len + s_block_reads_len) / 2) AS BIGINT) AS x FROM blk) b""",
        "blk",
    ),
)
def verbose_blocks(t: Tables):
    return sink.verbose_block_lines(t.blocks, t.contigs("m"), t.contigs("s"))


@query(
    "contig_check",
    oracle(
        """SELECT side, CAST(n AS BIGINT) AS outside FROM (SELECT 'm' AS side, count(*) AS n FROM blk WHERE m_ctg < 0 OR m_ctg > (SELECT max(ctg_id) FROM cm)
 UNION ALL SELECT 's', count(*) FROM blk WHERE s_ctg < 0 OR s_ctg > (SELECT max(ctg_id) FROM cs)) x""",
        "blk", "cm", "cs",
    ),
)
def contig_check(t: Tables):
    """Blocks whose contig the dictionary does not know, per side."""
    blocks = cut_lineage(t.blocks)
    out = None
    for side in ("m", "s"):
        stray = blocks.select(F.col(f"{side}_ctg").alias("ctg_id")).join(t.contigs(side), "ctg_id", "left_anti")
        row = stray.agg(F.count("*").alias("outside")).select(F.lit(side).alias("side"), "outside")
        out = row if out is None else out.unionByName(row)
    return out
