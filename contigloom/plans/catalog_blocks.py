"""Registered queries on blocks: building, coverage, filters, contig sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from contigloom.operators import block_filters as bf
from contigloom.operators import blocks as bl
from contigloom.operators import contig_sets as cs
from contigloom.operators import reads, regions
from contigloom.operators.tiled import ordered_neighbours
from contigloom.operators.ordering import block_order
from contigloom.plans.fixture import Tables, oracle
from contigloom.plans.registry import long, query
from contigloom.session import cut_lineage

_BLOCK = ("m_ctg", "s_ctg", "num_reads", "m_begin", "m_end", "s_begin", "s_end", "m_block_reads_len", "s_block_reads_len")
_BLOCK_SQL = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _BLOCK)
_KEY_SQL = "CAST(m_ctg AS BIGINT) AS m_ctg, CAST(s_ctg AS BIGINT) AS s_ctg, CAST(m_begin AS BIGINT) AS m_begin, CAST(s_begin AS BIGINT) AS s_begin"


def _block_cols(df, *more):
    return df.select(*[long(c).alias(c) for c in _BLOCK], *more)


def _key_cols(df, *more):
    return df.select(*[long(c).alias(c) for c in ("m_ctg", "s_ctg", "m_begin", "s_begin")], *more)


@query("blocks_islands", oracle(f"SELECT {_BLOCK_SQL} FROM blk", "blk"))
def blocks_islands(t: Tables):
    return _block_cols(t.blocks)


@query("blocks_greedy", oracle(f"SELECT {_BLOCK_SQL} FROM blk", "blk"))
def blocks_greedy(t: Tables):
    return _block_cols(bl.build_blocks(t.pairs))


@query("block_strand_vote", oracle(f"SELECT {_KEY_SQL}, '+' AS m_strand, s_strand FROM blk", "blk"))
def block_strand_vote(t: Tables):
    return _key_cols(bl.build_blocks(t.pairs), F.lit("+").alias("m_strand"), "s_strand")


@query("min_block_size", oracle(f"SELECT {_BLOCK_SQL} FROM blk WHERE num_reads >= 50", "blk"))
def min_block_size(t: Tables):
    return _block_cols(bf.min_block_size(t.blocks, 50))


# Blocks with all unique reads over each frame.
_COV = """cov AS (SELECT b.*,
 (SELECT sum(least(r.epos - 1, b.m_end) - greatest(r.pos, b.m_begin) + 1) FROM um r
  WHERE r.ctg = b.m_ctg AND r.pos <= b.m_end AND r.epos > b.m_begin) AS m_reads_len,
 (SELECT sum(least(r.epos - 1, b.s_end) - greatest(r.pos, b.s_begin) + 1) FROM us r
  WHERE r.ctg = b.s_ctg AND r.pos <= b.s_end AND r.epos > b.s_begin) AS s_reads_len FROM blk b)"""


def _covered(t: Tables):
    blocks = cut_lineage(t.blocks)
    return bl.with_frame_coverage(blocks, *[reads.usable_reads(t.alignments(side)) for side in "ms"])


@query(
    "frame_coverage",
    oracle(
        f"SELECT {_BLOCK_SQL}, CAST(m_reads_len AS BIGINT) AS m_reads_len, CAST(s_reads_len AS BIGINT) AS s_reads_len FROM cov",
        "blk", "um", "us",
        extra=_COV,
    ),
)
def frame_coverage(t: Tables):
    return _block_cols(_covered(t), long("m_reads_len").alias("m_reads_len"), long("s_reads_len").alias("s_reads_len"))


# The error-free reads cover nearly all of each frame, so a high threshold is used.
_RATIO = 0.97
_RATIO_SQL = _COV + """, rat AS (SELECT *, m_block_reads_len / m_reads_len AS m_ratio,
 s_block_reads_len / s_reads_len AS s_ratio FROM cov)"""


@query(
    "cov_ratio_filter",
    oracle(
        f"SELECT {_KEY_SQL}, round(m_ratio, 6) AS m_ratio, round(s_ratio, 6) AS s_ratio FROM rat WHERE greatest(m_ratio, s_ratio) >= {_RATIO}",
        "blk", "um", "us",
        extra=_RATIO_SQL,
    ),
)
def cov_ratio_filter(t: Tables):
    kept = bf.coverage_ratio_filter(_covered(t), _RATIO)
    return _key_cols(kept, F.round("m_ratio", 6).alias("m_ratio"), F.round("s_ratio", 6).alias("s_ratio"))


_SINGLE = """lnk AS (SELECT DISTINCT m_ctg, s_ctg FROM b50),
 single AS (SELECT m_ctg, s_ctg FROM (SELECT *, count(*) OVER (PARTITION BY m_ctg) AS md, count(*) OVER (PARTITION BY s_ctg) AS sd
 FROM lnk) d WHERE md = 1 OR sd = 1)"""
_B50 = "b50 AS (SELECT * FROM blk WHERE num_reads >= 50)"


@query("single_link_pairs", oracle("SELECT m_ctg, s_ctg FROM single", "blk", extra=f"{_B50}, {_SINGLE}"))
def single_link_pairs(t: Tables):
    return bf.single_link_pairs(bf.min_block_size(t.blocks, 50))


_MIN_COV = 9.0


@query(
    "min_cov_filter",
    oracle(
        f"""SELECT {_KEY_SQL}, round(c, 6) AS block_cov FROM (SELECT r.*, CASE WHEN m_ratio >= s_ratio
 THEN m_block_reads_len / (m_end - m_begin + 1) ELSE s_block_reads_len / (s_end - s_begin + 1) END AS c,
 EXISTS (SELECT 1 FROM single x WHERE x.m_ctg = r.m_ctg AND x.s_ctg = r.s_ctg) AS sl FROM rat r) q WHERE sl OR c >= {_MIN_COV}""",
        "blk", "um", "us",
        extra=f"{_B50}, {_SINGLE}, {_RATIO_SQL}",
    ),
)
def min_cov_filter(t: Tables):
    covered = cut_lineage(bf.coverage_ratios(_covered(t)))
    single = bf.single_link_pairs(bf.min_block_size(covered, 50))
    kept = bf.min_coverage_filter(covered, single, _MIN_COV)
    return _key_cols(kept, F.round("block_cov", 6).alias("block_cov"))


@query("pairing_evidence", oracle("SELECT m_ctg, s_ctg, CAST(count(*) AS BIGINT) AS evidence FROM blk GROUP BY m_ctg, s_ctg", "blk"))
def pairing_evidence(t: Tables):
    return bf.pairing_evidence(t.blocks)


@query(
    "strand_evidence",
    oracle(
        """SELECT m_ctg, s_ctg, CAST(sum(CASE WHEN s_strand = '+' THEN num_reads ELSE 0 END) AS BIGINT) AS positive,
 CAST(sum(CASE WHEN s_strand = '+' THEN 0 ELSE num_reads END) AS BIGINT) AS negative FROM blk GROUP BY m_ctg, s_ctg""",
        "blk",
    ),
)
def strand_evidence(t: Tables):
    from contigloom.operators.strands import strand_evidence as evidence

    return evidence(t.blocks)


@query(
    "strand_combine",
    oracle(
        """SELECT a.m_ctg, a.s_ctg, b.m_ctg AS via_ctg, round(a.p * b.p + (1 - a.p) * (1 - b.p), 6) AS prob FROM pr a JOIN pr b
 ON a.s_ctg = b.s_ctg AND a.m_ctg < b.m_ctg""",
        "pairs",
        extra="pr AS (SELECT m_ctg, s_ctg, avg(CASE WHEN concordant AND m_start % 3 > 0 THEN 1.0 ELSE 0.0 END) AS p FROM pairs GROUP BY m_ctg, s_ctg)",
    ),
)
def strand_combine(t: Tables):
    from contigloom.operators.strands import combine

    # a third of the pairs is made to disagree, so that the probabilities vary
    agree = F.when(F.col("concordant") & (F.col("m_start") % 3 > 0), 1.0).otherwise(0.0)
    pr = cut_lineage(t.pairs.groupBy("m_ctg", "s_ctg").agg(F.avg(agree).alias("p")))
    other = pr.select(F.col("m_ctg").alias("via_ctg"), "s_ctg", F.col("p").alias("q"))
    return (
        pr.join(other, "s_ctg")
        .where("m_ctg < via_ctg")
        .select("m_ctg", "s_ctg", "via_ctg", F.round(combine(F.col("p"), F.col("q")), 6).alias("prob"))
    )


@query(
    "strand_call",
    oracle(
        """SELECT m_ctg, s_ctg, CASE WHEN p < n THEN '-' WHEN p > n THEN '+' ELSE '?' END AS strand FROM (SELECT m_ctg, s_ctg,
 sum(CASE WHEN concordant AND m_start % 2 = 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN concordant AND m_start % 2 = 0 THEN 0 ELSE 1 END) AS n
 FROM pairs GROUP BY m_ctg, s_ctg) q""",
        "pairs",
    ),
)
def strand_call(t: Tables):
    from contigloom.operators.strands import strand_of_evidence

    agree = F.col("concordant") & (F.col("m_start") % 2 == 0)
    votes = t.pairs.groupBy("m_ctg", "s_ctg").agg(
        F.count_if(agree).alias("positive"), F.count_if(~agree).alias("negative")
    )
    return votes.select(
        "m_ctg", "s_ctg", strand_of_evidence(F.col("positive"), F.col("negative")).alias("strand")
    )


@query(
    "frame_read_overlap",
    oracle(
        """SELECT CAST(b.m_ctg AS BIGINT) AS m_ctg, CAST(b.s_ctg AS BIGINT) AS s_ctg, CAST(b.m_begin AS BIGINT) AS m_begin,
 CAST(count(*) AS BIGINT) AS touching, CAST(sum(CASE WHEN b.m_end - r.pos + 1 >= 20 AND r.epos - 1 - b.m_begin + 1 >= 20 THEN 1 ELSE 0 END) AS BIGINT)
 AS sharing FROM b10 b JOIN um r ON r.ctg = b.m_ctg AND b.m_end - r.pos + 1 >= 0 AND r.epos - 1 - b.m_begin + 1 >= 0
 GROUP BY b.m_ctg, b.s_ctg, b.m_begin""",
        "b10", "um",
    ),
)
def frame_read_overlap(t: Tables):
    frames = t.merge_blocks.select(
        F.col("m_ctg").alias("ctg"), "m_ctg", "s_ctg", "m_begin", "m_end",
        # one base of slack on both ends, so that touching counts
        F.greatest(F.col("m_begin") - 1, F.lit(0)).alias("begin"), (F.col("m_end") + 1).alias("end"),
    )
    near = regions.region_join(frames, reads.usable_reads(t.master).select("ctg", "pos", "epos"))
    args = (F.col("m_begin"), F.col("m_end"), F.col("pos"), F.col("epos") - 1)
    return (
        near.where(bf.frame_read_overlap(*args))
        .groupBy("m_ctg", "s_ctg", "m_begin")
        .agg(F.count("*").alias("touching"), F.count_if(bf.frame_read_overlap(*args, minimum=20)).alias("sharing"))
        .select("m_ctg", "s_ctg", long("m_begin").alias("m_begin"), "touching", "sharing")
    )


@query(
    "frame_overlap_pct",
    oracle(
        f"""SELECT {_KEY_SQL}, round(100.0 * greatest(least(m_end, ne) - greatest(m_begin, nb) + 1, 0) / (ne - nb + 1), 6) AS overlap_pct FROM (
 SELECT *, lead(m_begin) OVER w AS nb, lead(m_end) OVER w AS ne FROM b10 WINDOW w AS (PARTITION BY m_ctg ORDER BY m_begin, m_end DESC, s_ctg, s_begin)) x
 WHERE nb IS NOT NULL""",
        "b10",
    ),
)
def frame_overlap_pct(t: Tables):
    near = ordered_neighbours(t.merge_blocks, ["m_ctg"], "m_begin", block_order("m"), ["m_begin", "m_end"])
    pct = bf.frame_overlap_percent(
        F.col("m_begin"), F.col("m_end"), F.col("next_m_begin"), F.col("next_m_end")
    )
    return _key_cols(near.where("next_m_begin IS NOT NULL"), F.round(pct, 6).alias("overlap_pct"))


def _length_pass(src: str, out: str, side: str, other: str) -> str:
    b, e = f"{side}_begin", f"{side}_end"
    return f"""{out}x AS (SELECT *, lead({b}) OVER w AS nb, lead({e}) OVER w AS ne, lag({b}) OVER w AS pb, lag({e}) OVER w AS pe FROM {src}
 WINDOW w AS (PARTITION BY {side}_ctg ORDER BY {b}, {e} DESC, {other}_ctg, {other}_begin)),
 {out} AS (SELECT * EXCLUDE (nb, ne, pb, pe) FROM {out}x WHERE NOT (m_end - m_begin + 1 < 500 AND s_end - s_begin + 1 < 500 AND
 (coalesce(100.0 * greatest(least({e}, ne) - greatest({b}, nb) + 1, 0) / ({e} - {b} + 1) >= 0.5, false) OR
  coalesce(100.0 * greatest(least({e}, pe) - greatest({b}, pb) + 1, 0) / ({e} - {b} + 1) >= 0.5, false))))"""


@query(
    "block_length_filter",
    oracle(
        f"SELECT {_BLOCK_SQL} FROM p2",
        "blk",
        extra=f"{_length_pass('blk', 'p1', 'm', 's')}, {_length_pass('p1', 'p2', 's', 'm')}",
    ),
)
def block_length_filter(t: Tables):
    return _block_cols(bf.block_length_filter(t.blocks, t.contigs("m"), t.contigs("s")))


@query(
    "nbc_before_master",
    oracle("SELECT ctg_id, name FROM cm WHERE ctg_id NOT IN (SELECT m_ctg FROM b300)", "cm", "blk",
           extra="b300 AS (SELECT * FROM blk WHERE num_reads >= 300)"),
)
def nbc_before_master(t: Tables):
    return cs.contigs_without_blocks(t.contigs("m"), bf.min_block_size(t.blocks, 300), "m").select("ctg_id", "name")


@query(
    "nbc_before_slave",
    oracle("SELECT ctg_id, name FROM cs WHERE ctg_id NOT IN (SELECT s_ctg FROM b300)", "cs", "blk",
           extra="b300 AS (SELECT * FROM blk WHERE num_reads >= 300)"),
)
def nbc_before_slave(t: Tables):
    return cs.contigs_without_blocks(t.contigs("s"), bf.min_block_size(t.blocks, 300), "s").select("ctg_id", "name")


_AFTER = "b50 AS (SELECT * FROM blk WHERE num_reads >= 50), b300 AS (SELECT * FROM blk WHERE num_reads >= 300)"


@query(
    "nbc_after_slave",
    oracle(
        "SELECT ctg_id, name FROM cs WHERE ctg_id IN (SELECT s_ctg FROM b50) AND ctg_id NOT IN (SELECT s_ctg FROM b300)",
        "cs", "blk", extra=_AFTER,
    ),
)
def nbc_after_slave(t: Tables):
    blocks = cut_lineage(t.blocks)
    return cs.contigs_losing_blocks(
        t.contigs("s"), bf.min_block_size(blocks, 50), bf.min_block_size(blocks, 300), "s"
    ).select("ctg_id", "name")


@query(
    "not_merged_slave",
    oracle(
        """SELECT ctg_id, name FROM cs WHERE ctg_id NOT IN (SELECT s_ctg FROM b300 UNION SELECT ctg_id FROM cs WHERE ctg_id NOT IN
 (SELECT s_ctg FROM b50))""",
        "cs", "blk", extra=_AFTER,
    ),
)
def not_merged_slave(t: Tables):
    blocks = cut_lineage(t.blocks)
    contigs = t.contigs("s")
    used = bf.min_block_size(blocks, 300).select(F.col("s_ctg").alias("ctg_id"))
    never = cs.contigs_without_blocks(contigs, bf.min_block_size(blocks, 50), "s")
    return cs.unused_contigs(contigs, used, never).select("ctg_id", "name")


@query(
    "unmerged_master",
    oracle("SELECT ctg_id, name, length FROM cm WHERE ctg_id NOT IN (SELECT m_ctg FROM blk WHERE num_reads >= 300)", "cm", "blk"),
)
def unmerged_master(t: Tables):
    used = bf.min_block_size(t.blocks, 300).select(F.col("m_ctg").alias("ctg_id"))
    return cs.unused_contigs(t.contigs("m"), used).select("ctg_id", "name", "length")


@query(
    "contig_lookup",
    oracle(
        """SELECT b.m_ctg, b.s_ctg, cm.name AS m_name, cs.name AS s_name, CAST(num_reads AS BIGINT) AS num_reads FROM blk b
 JOIN cm ON cm.ctg_id = b.m_ctg JOIN cs ON cs.ctg_id = b.s_ctg""",
        "blk", "cm", "cs",
    ),
)
def contig_lookup(t: Tables):
    named = cs.contig_lookup(t.blocks, t.contigs("m"), "m_ctg", "m_name")
    named = cs.contig_lookup(named, t.contigs("s"), "s_ctg", "s_name")
    return named.select("m_ctg", "s_ctg", "m_name", "s_name", "num_reads")


def _order_sql(side: str, other: str) -> str:
    return f"""SELECT {_KEY_SQL}, CAST(row_number() OVER (ORDER BY {side}_ctg, {side}_begin, {side}_end DESC, {other}_ctg, {other}_begin) - 1
 AS BIGINT) AS ord FROM blk"""


@query("master_block_order", oracle(_order_sql("m", "s"), "blk"))
def master_block_order(t: Tables):
    from contigloom.operators.tiled import number_rows

    return _key_cols(number_rows(t.blocks, "m_ctg", "m_begin", block_order("m"), "ord"), "ord")


@query("slave_block_order", oracle(_order_sql("s", "m"), "blk"))
def slave_block_order(t: Tables):
    from contigloom.operators.tiled import number_rows

    return _key_cols(number_rows(t.blocks, "s_ctg", "s_begin", block_order("s"), "ord"), "ord")


@query(
    "frame_gap",
    oracle(
        f"""SELECT {_KEY_SQL}, CAST(m_begin - pe - 1 AS BIGINT) AS gap FROM (SELECT *, lag(m_end) OVER (PARTITION BY m_ctg
 ORDER BY m_begin, m_end DESC, s_ctg, s_begin) AS pe FROM blk) x WHERE pe IS NOT NULL""",
        "blk",
    ),
)
def frame_gap(t: Tables):
    near = ordered_neighbours(t.blocks, ["m_ctg"], "m_begin", block_order("m"), ["m_end"])
    gap = F.col("m_begin") - F.col("prev_m_end") - 1
    return _key_cols(near.where("prev_m_end IS NOT NULL"), long(gap).alias("gap"))


@query(
    "region_join",
    oracle(
        """SELECT CAST(b.m_ctg AS BIGINT) AS m_ctg, CAST(b.s_ctg AS BIGINT) AS s_ctg, CAST(b.m_begin AS BIGINT) AS m_begin, r.name,
 CAST(r.mate AS BIGINT) AS mate, CAST(r.pos AS BIGINT) AS pos FROM b10 b JOIN am r ON r.ctg = b.m_ctg AND r.pos < b.m_end + 1 AND r.epos > b.m_begin""",
        "b10", "am",
    ),
)
def region_join(t: Tables):
    frames = t.merge_blocks.select(
        F.col("m_ctg").alias("ctg"), "s_ctg", F.col("m_begin").alias("begin"), F.col("m_end").alias("end")
    )
    hits = regions.region_join(frames, t.master.select("name", "mate", "ctg", "pos", "epos"))
    return hits.select(
        F.col("ctg").alias("m_ctg"), "s_ctg", long("begin").alias("m_begin"), "name", long("mate").alias("mate"), long("pos").alias("pos")
    )
