"""Registered queries on sequences: scalars, seeds, FASTA lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from contigloom.functions import sequence as sq
from contigloom.operators import kmers
from contigloom.plans.fixture import Tables, oracle
from contigloom.plans.registry import long, query
from contigloom.session import cut_lineage


@query(
    "normalise_bases",
    oracle(
        """SELECT ctg_id, regexp_replace(upper(replace(lower(sequence), 'ca', 'Rx')), '[^ACGT]', 'N', 'g') AS bases FROM qm""", "qm"
    ),
)
def normalise_bases(t: Tables):
    # lower case with some other letters in it, as an input file may have
    raw = F.replace(F.lower("sequence"), F.lit("ca"), F.lit("Rx"))
    return t.sequences("m").select("ctg_id", sq.normalise(raw).alias("bases"))


@query(
    "reverse_complement",
    oracle(
        "SELECT ctg_id, reverse(translate(sequence, 'ACGT', 'TGCA')) AS revcomp, translate(sequence, 'ACGT', 'TGCA') AS comp FROM qs",
        "qs",
    ),
)
def reverse_complement(t: Tables):
    s = F.col("sequence")
    return t.sequences("s").select(
        "ctg_id", sq.reverse_complement(s).alias("revcomp"), sq.complement(s).alias("comp")
    )


@query(
    "subsequence",
    oracle(
        """SELECT m_ctg, s_ctg, CAST(m_begin AS BIGINT) AS m_begin, substring(sequence, CAST(m_begin AS BIGINT) + 1, CAST(m_end - m_begin + 1 AS BIGINT)) AS frame,
 substring(sequence, CAST(m_end AS BIGINT) + 2) AS right_tail, substring(sequence, 1, CAST(m_begin AS BIGINT)) AS left_tail FROM b10 JOIN qm ON qm.ctg_id = b10.m_ctg""",
        "b10", "qm",
    ),
)
def subsequence(t: Tables):
    s = F.col("sequence")
    # both grow with the input, so they meet by a shuffle
    joined = t.merge_blocks.hint("merge").join(t.sequences("m"), F.col("m_ctg") == F.col("ctg_id"))
    return joined.select(
        "m_ctg", "s_ctg", long("m_begin").alias("m_begin"),
        sq.chop_borders(s, F.col("m_begin"), F.col("m_end")).alias("frame"),
        sq.chop_begin(s, F.col("m_end") + 1).alias("right_tail"),
        sq.chop_end(s, F.col("m_begin") - 1).alias("left_tail"),
    )


@query(
    "bases_match",
    oracle(
        """SELECT a.ctg_id, CAST(coalesce(sum(CASE WHEN i <= b.length AND (substring(a.sequence, i, 1) = substring(b.sequence, i, 1)
 OR substring(a.sequence, i, 1) = 'A') THEN 1 ELSE 0 END), 0) AS BIGINT) AS matches, coalesce(a.sequence = b.sequence, false) AS same
 FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM qm) a LEFT JOIN qs b ON a.ctg_id = b.ctg_id GROUP BY a.ctg_id, same""",
        "qm", "qs",
    ),
)
def bases_match(t: Tables):
    """Position-wise matches of every master contig with the equally numbered slave contig, an unknown base matching anything."""
    a = t.sequences("m").select("ctg_id", F.col("sequence").alias("a"))
    b = t.sequences("s").select("ctg_id", F.col("sequence").alias("b"))
    masked = F.translate("a", "A", "N")
    letters = F.zip_with(
        F.split(masked, ""),
        F.split(F.coalesce("b", F.lit("")), ""),
        lambda x, y: F.when((x != "") & (y != "") & sq.bases_match(x, y), 1).otherwise(0),
    )
    return a.join(b, "ctg_id", "left").select(
        "ctg_id",
        F.aggregate(letters, F.lit(0), lambda acc, v: acc + v).cast("long").alias("matches"),
        F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"),
    )


@query(
    "fasta_wrap60",
    oracle(
        """SELECT name, CAST(i AS BIGINT) AS line_no, substring(sequence, CAST(i * 60 AS BIGINT) + 1, 60) AS line FROM (
 SELECT name, sequence, unnest(range(0, CAST(ceil(length / 60.0) AS BIGINT))) AS i FROM qs) x""",
        "qs",
    ),
)
def fasta_wrap60(t: Tables):
    return t.sequences("s").select("name", F.posexplode(sq.fasta_lines(F.col("sequence"))).alias("line_no", "line")).select(
        "name", long("line_no").alias("line_no"), "line"
    )


def _oriented_words(t: Tables):
    """Words of both contigs of every contig pair, the slave read forward."""
    pairs = cut_lineage(t.merge_blocks.select("m_ctg", "s_ctg").distinct())
    m = t.sequences("m").select(F.col("ctg_id").alias("m_ctg"), F.col("sequence").alias("a"))
    s = t.sequences("s").select(
        F.col("ctg_id").alias("s_ctg"),
        F.when(F.col("ctg_id") % 2 == 1, sq.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")).alias("b"),
    )
    key = F.struct("m_ctg", "s_ctg").alias("pair")
    a = kmers.words(pairs.join(m, "m_ctg").select(key, "a"), "pair", F.col("a"))
    b = kmers.words(pairs.join(s, "s_ctg").select(key, "b"), "pair", F.col("b"))
    return a, b


_WORDS = """pr AS (SELECT DISTINCT m_ctg, s_ctg FROM b10),
 wa AS (SELECT m_ctg, s_ctg, i, substring(sequence, CAST(i AS BIGINT) + 1, 20) AS w FROM (SELECT m_ctg, s_ctg, sequence, unnest(range(0, 9981)) AS i
 FROM pr JOIN qm ON ctg_id = m_ctg) x),
 wb AS (SELECT m_ctg, s_ctg, i, substring(q, CAST(i AS BIGINT) + 1, 20) AS w FROM (SELECT m_ctg, s_ctg, unnest(range(0, 6981)) AS i,
 CASE WHEN s_ctg % 2 = 1 THEN reverse(translate(sequence, 'ACGT', 'TGCA')) ELSE sequence END AS q FROM pr JOIN qs ON ctg_id = s_ctg) x),
 dg AS (SELECT a.m_ctg, a.s_ctg, a.i - b.i AS diag, count(*) AS hits FROM wa a JOIN wb b ON a.m_ctg = b.m_ctg AND a.s_ctg = b.s_ctg AND a.w = b.w
 WHERE a.i >= b.i GROUP BY a.m_ctg, a.s_ctg, a.i - b.i)"""


@query(
    "kmer_diagonal_hits",
    oracle(
        """SELECT m_ctg, s_ctg, CAST(diag AS BIGINT) AS diag, CAST(hits AS BIGINT) AS hits FROM (SELECT *, rank() OVER (PARTITION BY m_ctg, s_ctg
 ORDER BY hits DESC) AS r FROM dg) x WHERE r = 1""",
        "b10", "qm", "qs", extra=_WORDS,
    ),
)
def kmer_diagonal_hits(t: Tables):
    a, b = _oriented_words(t)
    best = kmers.best_diagonals(a, b, "pair")
    return best.select("pair.m_ctg", "pair.s_ctg", "diag", "hits")
