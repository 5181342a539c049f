"""Registered queries on reads: filters, scalars, statistics, pairing, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from contigloom.functions import cigar as cg
from contigloom.functions import intervals as iv
from contigloom.functions import tags as tg
from contigloom.operators import coverage, reads, stats
from contigloom.plans.fixture import Tables, oracle
from contigloom.plans.registry import long, query

_READ = ("name", "mate", "ctg", "pos", "epos")
_READ_SQL = "name, CAST(mate AS BIGINT) AS mate, ctg, CAST(pos AS BIGINT) AS pos, CAST(epos AS BIGINT) AS epos"


def _read_cols(df):
    return df.select("name", *[long(c).alias(c) for c in _READ[1:]])


@query("good_reads", oracle(f"SELECT {_READ_SQL} FROM am WHERE (flag & 1796) = 0 AND pos >= 0", "am"))
def good_reads(t: Tables):
    return _read_cols(reads.good_reads(t.alignments("m")))


@query("unique_reads", oracle(f"SELECT {_READ_SQL} FROM asl WHERE (flag & 1796) = 0 AND nh = 1", "asl"))
def unique_reads(t: Tables):
    return _read_cols(reads.usable_reads(t.alignments("s")))


@query(
    "flag_predicates",
    oracle(
        """SELECT CAST(ctg AS BIGINT) AS ctg, CAST(count(*) AS BIGINT) AS n,
 CAST(sum(CASE WHEN (flag & 1) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_paired,
 CAST(sum(CASE WHEN (flag & 2) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_proper_pair,
 CAST(sum(CASE WHEN (flag & 4) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unmapped,
 CAST(sum(CASE WHEN (flag & 8) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_mate_unmapped,
 CAST(sum(CASE WHEN (flag & 16) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_reverse,
 CAST(sum(CASE WHEN (flag & 32) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_mate_reverse,
 CAST(sum(CASE WHEN (flag & 64) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_first_mate,
 CAST(sum(CASE WHEN (flag & 128) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_second_mate,
 CAST(sum(CASE WHEN (flag & 256) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_secondary,
 CAST(sum(CASE WHEN (flag & 512) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed_qc,
 CAST(sum(CASE WHEN (flag & 1024) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicate,
 CAST(sum((flag | 512) & ~1024) AS BIGINT) AS edited_flags
 FROM am GROUP BY ctg""",
        "am",
    ),
)
def flag_predicates(t: Tables):
    edited = reads.set_flag("duplicate", False, reads.set_flag("failed_qc", True))
    return t.alignments("m").groupBy(long("ctg").alias("ctg")).agg(
        F.count("*").alias("n"),
        *[F.count_if(reads.has_flag(b)).alias(f"n_{b}") for b in reads.FLAG_BITS],
        F.sum(long(edited)).alias("edited_flags"),
    )


_CIGAR_SQL = """CASE WHEN len % 3 = 0 THEN concat(CAST(len AS STRING), 'M')
 WHEN len % 3 = 1 THEN concat('5S', CAST(len - 5 AS STRING), 'M')
 ELSE concat('10M2D', CAST(len - 13 AS STRING), 'M3I') END"""


def _with_cigar(t: Tables):
    return t.alignments("m").withColumn("cigar", cg.parse_cigar(F.expr(_CIGAR_SQL)))


@query(
    "cigar_end_pos",
    oracle(
        f"""SELECT name, CAST(mate AS BIGINT) AS mate, CAST(pos AS BIGINT) AS pos, {_CIGAR_SQL} AS cigar_text,
 CAST(pos + CASE WHEN len % 3 = 0 THEN len WHEN len % 3 = 1 THEN len - 5 ELSE len - 1 END AS BIGINT) AS end_pos,
 CAST(pos + CASE WHEN len % 3 = 0 THEN len WHEN len % 3 = 1 THEN len - 5 ELSE len + 2 END - 1 AS BIGINT) AS last_padded
 FROM am""",
        "am",
    ),
)
def cigar_end_pos(t: Tables):
    df = _with_cigar(t)
    return df.select(
        "name",
        long("mate").alias("mate"),
        long("pos").alias("pos"),
        F.expr(_CIGAR_SQL).alias("cigar_text"),
        long(cg.end_position(F.col("pos"), F.col("cigar"))).alias("end_pos"),
        long(cg.end_position(F.col("pos"), F.col("cigar"), padded=True, closed=True)).alias("last_padded"),
    )


@query(
    "soft_clips",
    oracle(
        """SELECT name, CAST(mate AS BIGINT) AS mate, CAST(5 AS BIGINT) AS clip_size, CAST(5 AS BIGINT) AS read_pos,
 CAST(pos AS BIGINT) AS genome_pos FROM am WHERE len % 3 = 1""",
        "am",
    ),
)
def soft_clips(t: Tables):
    df = _with_cigar(t).select(
        "name", "mate", F.explode(cg.soft_clips(F.col("pos"), F.col("cigar"))).alias("c")
    )
    return df.select(
        "name",
        long("mate").alias("mate"),
        long("c.size").alias("clip_size"),
        F.col("c.read_pos").alias("read_pos"),
        F.col("c.genome_pos").alias("genome_pos"),
    )


# Read bases for codec-style tests: hashed from the name, cut to the read length.
_SEQ_SQL = """substring(translate(concat(md5(name), md5(concat(name, 'a')), md5(concat(name, 'b')), md5(concat(name, 'c'))),
 '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, len)"""


@query(
    "aligned_bases",
    oracle(
        f"""SELECT name, CAST(mate AS BIGINT) AS mate, CASE WHEN len % 3 = 0 THEN s WHEN len % 3 = 1 THEN substring(s, 6)
 ELSE concat(substring(s, 1, 10), '--', substring(s, 11)) END AS bases
 FROM (SELECT name, mate, len, {_SEQ_SQL} AS s FROM am) x""",
        "am",
    ),
)
def aligned_bases(t: Tables):
    df = _with_cigar(t).withColumn("seq", F.expr(_SEQ_SQL))
    return df.select(
        "name", long("mate").alias("mate"), cg.aligned_bases(F.col("seq"), F.col("cigar")).alias("bases")
    )


def _with_tags(t: Tables):
    """NH stored signed on even contigs and unsigned on odd ones, XT on mate 1 only."""

    def value(kind, number, text=None):
        return F.struct(
            kind.alias("type"),
            number.cast("long").alias("i"),
            F.lit(None).cast("double").alias("f"),
            (F.lit(None) if text is None else text).cast("string").alias("s"),
            F.lit(None).cast("array<double>").alias("arr"),
        )

    nh = value(F.when(F.col("ctg") % 2 == 0, "i").otherwise("C"), F.col("nh"))
    xt = value(F.lit("A"), F.lit(85))
    base = F.create_map(F.lit("NH"), nh)
    return t.alignments("m").withColumn(
        "tags", F.when(F.col("mate") == 1, F.map_concat(base, F.create_map(F.lit("XT"), xt))).otherwise(base)
    )


@query(
    "tag_lookup",
    oracle(
        """SELECT name, CAST(mate AS BIGINT) AS mate, CAST(nh AS BIGINT) AS nh_value,
 CAST(CASE WHEN ctg % 2 = 0 THEN nh ELSE NULL END AS BIGINT) AS nh_signed, mate = 1 AS has_xt,
 CASE WHEN ctg % 2 = 0 THEN 'i' ELSE 'C' END AS nh_type,
 CASE WHEN mate = 1 THEN 'NH,XT' ELSE 'NH' END AS tag_names FROM am""",
        "am",
    ),
)
def tag_lookup(t: Tables):
    tags = F.col("tags")
    return _with_tags(t).select(
        "name",
        long("mate").alias("mate"),
        tg.int_tag(tags, "NH").alias("nh_value"),
        tg.int_tag(tags, "NH", signed_only=True).alias("nh_signed"),
        tg.has_tag(tags, "XT").alias("has_xt"),
        tg.tag_type(tags, "NH").alias("nh_type"),
        F.array_join(tg.tag_names(tags), ",").alias("tag_names"),
    )


@query(
    "tag_edit",
    oracle(
        """SELECT name, CAST(mate AS BIGINT) AS mate, CAST(CASE WHEN mate = 1 THEN 85 ELSE 82 END AS BIGINT) AS xt_added,
 CAST(nh + 10 AS BIGINT) AS nh_edited, CASE WHEN mate = 1 THEN 'XT' ELSE '' END AS left_after_remove FROM am""",
        "am",
    ),
)
def tag_edit(t: Tables):
    def number(v):
        return F.struct(
            F.lit("i").alias("type"), v.cast("long").alias("i"), F.lit(None).cast("double").alias("f"),
            F.lit(None).cast("string").alias("s"), F.lit(None).cast("array<double>").alias("arr"),
        )

    tags = F.col("tags")
    return _with_tags(t).select(
        "name",
        long("mate").alias("mate"),
        tg.int_tag(tg.add_tag(tags, "XT", number(F.lit(82))), "XT").alias("xt_added"),
        tg.int_tag(tg.set_tag(tags, "NH", number(F.col("nh") + 10)), "NH").alias("nh_edited"),
        F.array_join(tg.tag_names(tg.remove_tag(tags, "NH")), ",").alias("left_after_remove"),
    )


@query(
    "min_bin",
    oracle(
        """SELECT name, CAST(mate AS BIGINT) AS mate, CAST(CASE WHEN pos >> 14 = (epos - 1) >> 14 THEN 4681 + (pos >> 14)
 WHEN pos >> 17 = (epos - 1) >> 17 THEN 585 + (pos >> 17) WHEN pos >> 20 = (epos - 1) >> 20 THEN 73 + (pos >> 20)
 WHEN pos >> 23 = (epos - 1) >> 23 THEN 9 + (pos >> 23) WHEN pos >> 26 = (epos - 1) >> 26 THEN 1 + (pos >> 26)
 ELSE 0 END AS BIGINT) AS bin FROM (SELECT name, mate, gpos AS pos, gpos + len AS epos FROM reads) r""",
        "reads",
    ),
)
def min_bin(t: Tables):
    end = F.col("gpos") + F.col("len")
    return t.reads.select(
        "name", long("mate").alias("mate"), iv.minimum_bin(F.col("gpos"), end).alias("bin")
    )


@query(
    "candidate_bins",
    oracle(
        """SELECT bin, CAST(count(*) AS BIGINT) AS n_reads FROM (
 SELECT 0 AS bin FROM r UNION ALL SELECT unnest(range(1 + (a >> 26), 2 + (b >> 26))) FROM r
 UNION ALL SELECT unnest(range(9 + (a >> 23), 10 + (b >> 23))) FROM r
 UNION ALL SELECT unnest(range(73 + (a >> 20), 74 + (b >> 20))) FROM r
 UNION ALL SELECT unnest(range(585 + (a >> 17), 586 + (b >> 17))) FROM r
 UNION ALL SELECT unnest(range(4681 + (a >> 14), 4682 + (b >> 14))) FROM r) x GROUP BY bin""",
        "reads",
        extra="r AS (SELECT gpos AS a, gpos + len - 1 AS b FROM reads)",
    ),
)
def candidate_bins(t: Tables):
    bins = iv.candidate_bins(F.col("gpos"), F.col("gpos") + F.col("len"))
    return t.reads.select(F.explode(bins).alias("bin")).groupBy("bin").agg(F.count("*").alias("n_reads"))


def _library_coverage(t: Tables, side: str):
    size = t.contigs(side).agg(F.sum("length").alias("asm_size"))
    aln = t.master if side == "m" else t.slave
    return coverage.library_coverage(reads.good_reads(aln), size)


@query(
    "lib_coverage",
    oracle(
        """SELECT CAST(lib_id AS BIGINT) AS lib_id, CAST(sum(epos - pos) AS BIGINT) AS reads_len,
 round(sum(epos - pos) / (SELECT sum(length) FROM cm), 6) AS coverage FROM am WHERE (flag & 1796) = 0 GROUP BY lib_id""",
        "am", "cm",
    ),
)
def lib_coverage(t: Tables):
    return _library_coverage(t, "m").select(
        long("lib_id").alias("lib_id"), "reads_len", F.round("coverage", 6).alias("coverage")
    )


@query(
    "glob_coverage",
    oracle(
        """SELECT round(sum(c), 6) AS glob_coverage, round(avg(c), 6) AS mean_coverage FROM (
 SELECT lib_id, sum(epos - pos) / (SELECT sum(length) FROM cs) AS c FROM asl WHERE (flag & 1796) = 0 GROUP BY lib_id) x""",
        "asl", "cs",
    ),
)
def glob_coverage(t: Tables):
    return coverage.global_coverage(_library_coverage(t, "s")).select(
        F.round("glob_coverage", 6).alias("glob_coverage"), F.round("mean_coverage", 6).alias("mean_coverage")
    )


@query(
    "isize_stats",
    oracle(
        """SELECT CAST(lib_id AS BIGINT) AS lib_id, CAST(n AS BIGINT) AS n, round(mu, 6) AS isize_mean,
 round(sd, 6) AS isize_std FROM libs""",
        "libs",
    ),
)
def isize_stats(t: Tables):
    return t.library_stats("m").select(
        long("lib_id").alias("lib_id"),
        "n",
        F.round("isize_mean", 6).alias("isize_mean"),
        F.round("isize_std", 6).alias("isize_std"),
    )


@query(
    "read_pairs",
    oracle(
        """SELECT m_ctg, s_ctg, CAST(m_start AS BIGINT) AS m_start, CAST(m_last AS BIGINT) AS m_last,
 CAST(s_start AS BIGINT) AS s_start, CAST(s_last AS BIGINT) AS s_last, name, CAST(mate AS BIGINT) AS mate, concordant FROM pairs""",
        "pairs",
    ),
)
def read_pairs(t: Tables):
    p = t.pairs
    return p.select(
        "m_ctg", "s_ctg", *[long(c).alias(c) for c in ("m_start", "m_last", "s_start", "s_last")],
        "name", long("mate").alias("mate"), "concordant",
    )


@query(
    "base_depth",
    oracle(
        """SELECT ctg, CAST(w."at" AS BIGINT) AS "begin", CAST(nxt AS BIGINT) AS "end", CAST(depth AS BIGINT) AS depth FROM (
 SELECT ctg, "at", lead("at") OVER (PARTITION BY ctg ORDER BY "at") AS nxt, sum(d) OVER (PARTITION BY ctg ORDER BY "at") AS depth
 FROM (SELECT ctg, "at", sum(d) AS d FROM (SELECT ctg, pos AS "at", 1 AS d FROM um UNION ALL SELECT ctg, epos, -1 FROM um) e
 GROUP BY ctg, "at" HAVING sum(d) <> 0) g) w WHERE depth > 0""",
        "um",
    ),
)
def base_depth(t: Tables):
    return coverage.base_depth(reads.usable_reads(t.master))


@query(
    "multi_bam_union",
    oracle(
        """SELECT CAST(lib_id AS BIGINT) AS lib_id, ctg, CAST(pos AS BIGINT) AS pos, name, CAST(mate AS BIGINT) AS mate FROM am
 WHERE lib_id = 0 UNION ALL SELECT CAST(lib_id AS BIGINT) AS lib_id, ctg, CAST(pos AS BIGINT) AS pos, name,
 CAST(mate AS BIGINT) AS mate FROM am WHERE lib_id = 1""",
        "am",
    ),
)
def multi_bam_union(t: Tables):
    libs = [t.master.where(F.col("lib_id") == i) for i in (0, 1)]
    return reads.union_libraries(*libs).select(
        long("lib_id").alias("lib_id"), "ctg", long("pos").alias("pos"), "name", long("mate").alias("mate")
    )


@query(
    "region_scan",
    oracle(f"SELECT {_READ_SQL} FROM am WHERE ctg = 1 AND pos < 4001 AND epos > 2000", "am"),
)
def region_scan(t: Tables):
    from contigloom.operators.regions import region_scan as scan

    return _read_cols(scan(t.alignments("m"), 1, 2000, 4001))


@query(
    "n50_stats",
    oracle(
        """SELECT CAST(count(*) AS BIGINT) AS contigs, CAST(sum(length) AS BIGINT) AS total, round(avg(length), 6) AS avg_len,
 CAST(max(length) AS BIGINT) AS max_len, CAST(min(length) AS BIGINT) AS min_len,
 (SELECT min(CASE WHEN 2 * cum >= tot THEN -length END) * -1 FROM r) AS n50_len,
 (SELECT CAST(min(rn) AS BIGINT) FROM r WHERE 2 * cum >= tot) AS l50_count FROM len""",
        "blk",
        extra="""len AS (SELECT m_end - m_begin + 1 AS length FROM blk),
 r AS (SELECT length, row_number() OVER (ORDER BY length DESC) AS rn, sum(length) OVER (ORDER BY length DESC
 ROWS UNBOUNDED PRECEDING) AS cum, sum(length) OVER () AS tot FROM len)""",
    ),
)
def n50_stats(t: Tables):
    lengths = t.blocks.select((F.col("m_end") - F.col("m_begin") + 1).alias("length"))
    return stats.assembly_stats(lengths).withColumn("avg_len", F.round("avg_len", 6))


@query(
    "interval_flip",
    oracle(
        """SELECT name, CAST(mate AS BIGINT) AS mate, CAST(7000 - (epos - 1) - 1 AS BIGINT) AS "begin",
 CAST(7000 - pos - 1 AS BIGINT) AS "end" FROM asl""",
        "asl",
    ),
)
def interval_flip(t: Tables):
    begin, end = iv.flip(F.col("pos"), F.col("epos") - 1, F.lit(7000))
    return t.alignments("s").select(
        "name", long("mate").alias("mate"), long(begin).alias("begin"), long(end).alias("end")
    )


@query(
    "sort_by_position",
    oracle(
        """SELECT name, CAST(mate AS BIGINT) AS mate, CAST(row_number() OVER (PARTITION BY ctg ORDER BY pos, lib_id, name, mate)
 AS BIGINT) AS ord FROM am""",
        "am",
    ),
)
def sort_by_position(t: Tables):
    from contigloom.operators.ordering import position_ordinal

    return position_ordinal(t.master).select("name", long("mate").alias("mate"), "ord")


@query(
    "sort_by_name",
    oracle("SELECT name, CAST(mate AS BIGINT) AS mate, CAST(pos AS BIGINT) AS pos FROM asl ORDER BY name, mate", "asl"),
)
def sort_by_name(t: Tables):
    from contigloom.operators.ordering import sort_by_name as by_name

    return by_name(t.alignments("s")).select("name", long("mate").alias("mate"), long("pos").alias("pos"))


@query(
    "sort_by_tag",
    oracle(
        "SELECT name, CAST(mate AS BIGINT) AS mate, CASE WHEN mate = 1 THEN 85 END AS xt FROM am ORDER BY xt NULLS LAST, name",
        "am",
    ),
)
def sort_by_tag(t: Tables):
    from contigloom.operators.ordering import sort_by_tag as by_tag

    df = _with_tags(t).withColumn("xt", tg.int_tag(F.col("tags"), "XT").cast("int"))
    return by_tag(df, "xt").select("name", long("mate").alias("mate"), "xt")
