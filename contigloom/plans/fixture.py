"""Read tables derived from ``lineitem``: every order line is one sequenced fragment.

The genome is 20 bases per fragment.  The master assembly tiles it in contigs
of 10000 bases, the slave assembly in contigs of 7000 shifted by 3500 with odd
contigs reverse-complemented.  One SQL text serves Spark and the oracle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigloom.session import cut_lineage, short_lived, spread

M_LEN, S_LEN, S_SHIFT = 10000, 7000, 3500

_K = """SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_quantity) AS q,
 max(CASE WHEN l_discount = 0 THEN 2 ELSE 1 END) AS nh
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""
_FRAG = """SELECT concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS name,
 (l_orderkey * 7919 + l_linenumber * 104729) % (SELECT 20 * count(*) FROM {k}) AS g0,
 CAST(50 + q AS INT) AS len, CAST(300 + pk % 101 AS INT) AS isz, nh FROM {k}"""
_READS = """SELECT name, 1 AS mate, g0 AS gpos, g0 + isz - len AS mgpos, len, nh, false AS rev FROM {frag}
 UNION ALL SELECT name, 2 AS mate, g0 + isz - len AS gpos, g0 AS mgpos, len, nh, true AS rev FROM {frag}"""
_PLACED = {
    "m": """SELECT name, mate, len, nh, rev,
 CAST((gpos - gpos % 10000) / 10000 AS BIGINT) AS c, gpos % 10000 AS p,
 CAST((mgpos - mgpos % 10000) / 10000 AS BIGINT) AS mc, mgpos % 10000 AS mp, 10000 AS clen
 FROM {reads} WHERE gpos % 10000 + len <= 10000""",
    "s": """SELECT name, mate, len, nh, rev,
 CAST((gpos + 3500 - (gpos + 3500) % 7000) / 7000 AS BIGINT) AS c, (gpos + 3500) % 7000 AS p,
 CAST((mgpos + 3500 - (mgpos + 3500) % 7000) / 7000 AS BIGINT) AS mc, (mgpos + 3500) % 7000 AS mp, 7000 AS clen
 FROM {reads} WHERE (gpos + 3500) % 7000 + len <= 7000""",
}
_FLIP = {"m": "{c} < 0", "s": "{c} % 2 = 1"}


def _aln_sql(side: str) -> str:
    own, mate = _FLIP[side].format(c="c"), _FLIP[side].format(c="mc")
    return f"""SELECT name, mate, c AS ctg, pos, pos + len AS epos, rev, nh, len, len % 2 AS lib_id,
 mc AS mctg, mpos, mmap, mrev,
 3 + CASE WHEN mmap THEN 0 ELSE 8 END + CASE WHEN rev THEN 16 ELSE 0 END + CASE WHEN mrev THEN 32 ELSE 0 END
 + CASE WHEN mate = 1 THEN 64 ELSE 128 END + CASE WHEN nh = 2 AND mate = 2 THEN 1024 ELSE 0 END AS flag
 FROM (SELECT name, mate, c, nh, len, mc, mp + len <= clen AS mmap,
 CASE WHEN {own} THEN clen - p - len ELSE p END AS pos,
 CASE WHEN {mate} THEN clen - mp - len ELSE mp END AS mpos,
 CASE WHEN {own} THEN NOT rev ELSE rev END AS rev,
 CASE WHEN {mate} THEN rev ELSE NOT rev END AS mrev FROM {{placed}}) t"""


# Common table expressions for the oracle, by name, in dependency order.
_CTES = {
    "k": _K.format(lineitem="lineitem"),
    "frag": _FRAG.format(k="k"),
    "reads": _READS.format(frag="frag"),
    "placed_m": _PLACED["m"].format(reads="reads"),
    "placed_s": _PLACED["s"].format(reads="reads"),
    "am": _aln_sql("m").format(placed="placed_m"),
    "asl": _aln_sql("s").format(placed="placed_s"),
    # good and unique reads of both sides
    "um": "SELECT * FROM am WHERE (flag & 1796) = 0 AND nh = 1",
    "us": "SELECT * FROM asl WHERE (flag & 1796) = 0 AND nh = 1",
    "pairs": """SELECT m.ctg AS m_ctg, s.ctg AS s_ctg, m.pos AS m_start, m.epos - 1 AS m_last,
 s.pos AS s_start, s.epos - 1 AS s_last, m.name, m.mate, m.rev = s.rev AS concordant
 FROM um m JOIN us s ON m.name = s.name AND m.mate = s.mate""",
    "isl0": """SELECT *, max(s_last) OVER (PARTITION BY m_ctg, s_ctg ORDER BY s_start, name, mate
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_last FROM pairs""",
    "isl1": """SELECT *, sum(CASE WHEN prev_last IS NULL OR s_start > prev_last + 1 THEN 1 ELSE 0 END)
 OVER (PARTITION BY m_ctg, s_ctg ORDER BY s_start, name, mate ROWS UNBOUNDED PRECEDING) AS k FROM isl0""",
    "isl2": """SELECT *, row_number() OVER (PARTITION BY m_ctg, s_ctg, k
 ORDER BY s_start, s_last, m_start, m_last, CASE WHEN concordant THEN 0 ELSE 1 END) AS rn FROM isl1""",
    "blk": """SELECT m_ctg, s_ctg, CAST(count(*) AS BIGINT) AS num_reads, min(m_start) AS m_begin, max(m_last) AS m_end,
 min(s_start) AS s_begin, max(s_last) AS s_end, CAST(sum(m_last - m_start + 1) AS BIGINT) AS m_block_reads_len,
 CAST(sum(s_last - s_start + 1) AS BIGINT) AS s_block_reads_len,
 CASE WHEN sum(CASE WHEN rn > 1 THEN CASE WHEN concordant THEN 1 ELSE -1 END ELSE 0 END) >= 0
 THEN '+' ELSE '-' END AS s_strand FROM isl2 GROUP BY m_ctg, s_ctg, k""",
    # blocks of the merge steps
    "b10": "SELECT * FROM blk",
    "cm": """SELECT CAST(i AS BIGINT) AS ctg_id, concat('m', CAST(i AS STRING)) AS name, CAST(10000 AS BIGINT) AS length
 FROM (SELECT unnest(range(0, (SELECT max(ctg) + 1 FROM am))) AS i) t""",
    "cs": """SELECT CAST(i AS BIGINT) AS ctg_id, concat('s', CAST(i AS STRING)) AS name, CAST(7000 AS BIGINT) AS length
 FROM (SELECT unnest(range(0, (SELECT max(ctg) + 1 FROM asl))) AS i) t""",
    "libs": """SELECT lib_id, count(*) AS n, avg(isize) AS mu, sqrt(var_pop(isize) * count(*) / (count(*) + 1)) AS sd
 FROM (SELECT lib_id, CASE WHEN pos < mpos THEN mpos + len - pos ELSE epos - mpos END AS isize,
 CASE WHEN pos < mpos THEN NOT rev AND mrev ELSE rev AND NOT mrev END AS facing
 FROM am WHERE (flag & 1796) = 0 AND (flag & 1) <> 0 AND (flag & 64) <> 0 AND (flag & 8) = 0 AND ctg = mctg) t
 WHERE facing AND isize BETWEEN 90 AND 500 GROUP BY lib_id""",
    "libs_s": """SELECT lib_id, count(*) AS n, avg(isize) AS mu, sqrt(var_pop(isize) * count(*) / (count(*) + 1)) AS sd
 FROM (SELECT lib_id, CASE WHEN pos < mpos THEN mpos + len - pos ELSE epos - mpos END AS isize,
 CASE WHEN pos < mpos THEN NOT rev AND mrev ELSE rev AND NOT mrev END AS facing
 FROM asl WHERE (flag & 1796) = 0 AND (flag & 1) <> 0 AND (flag & 64) <> 0 AND (flag & 8) = 0 AND ctg = mctg) t
 WHERE facing AND isize BETWEEN 90 AND 500 GROUP BY lib_id""",
    "qm": """SELECT ctg_id, name, length, substring(string_agg(translate(md5(CAST(i - 110 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'),
 '' ORDER BY i), CAST(any_value(a % 32) AS BIGINT) + 1, 10000) AS sequence FROM (SELECT *, unnest(range(a >> 5, 1 + ((a + 9999) >> 5))) AS i FROM (
 SELECT *, ctg_id * 10000 + 3520 AS a FROM cm) x) y GROUP BY ctg_id, name, length""",
    "qs": """SELECT ctg_id, name, length, CASE WHEN ctg_id % 2 = 1 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS sequence FROM (
 SELECT ctg_id, name, length, substring(string_agg(translate(md5(CAST(i - 110 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'),
 '' ORDER BY i), CAST(any_value(a % 32) AS BIGINT) + 1, 7000) AS q FROM (SELECT *, unnest(range(a >> 5, 1 + ((a + 6999) >> 5))) AS i FROM (
 SELECT *, ctg_id * 7000 - 3500 + 3520 AS a FROM cs) x) y GROUP BY ctg_id, name, length) z""",
}
_NEEDS = {
    "frag": ["k"], "reads": ["frag"], "placed_m": ["reads"], "placed_s": ["reads"],
    "am": ["placed_m"], "asl": ["placed_s"], "um": ["am"], "us": ["asl"],
    "pairs": ["um", "us"], "isl0": ["pairs"], "isl1": ["isl0"], "isl2": ["isl1"],
    "blk": ["isl2"], "b10": ["blk"], "cm": ["am"], "cs": ["asl"], "qm": ["cm"], "qs": ["cs"], "libs": ["am"], "libs_s": ["asl"],
}


def oracle(body: str, *tables: str, extra: str = "", recursive: bool = False) -> str:
    """Prefix ``body`` with the fixture tables it names (and their inputs)."""
    wanted: set[str] = set()
    todo = list(tables)
    while todo:
        t = todo.pop()
        if t not in wanted:
            wanted.add(t)
            todo += _NEEDS.get(t, [])
    ctes = [f"{n} AS ({sql})" for n, sql in _CTES.items() if n in wanted]
    if extra:
        ctes.append(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(ctes) + " " + body


class Tables:
    """The derived tables as DataFrames, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._stored: dict[tuple[str, str], DataFrame] = {}

    def _once(self, table: str, side: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of an assembly, stored at its first use.

        Rows that come from a list or a hash look small to the planner, which
        would then broadcast them; a stored table has the size that was written.
        """
        if (table, side) not in self._stored:
            self._stored[table, side] = cut_lineage(make())
        return self._stored[table, side]

    @cached_property
    def frag(self) -> DataFrame:
        lineitem = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")
        # stored, since both assemblies read the rows and their number
        k = cut_lineage(self.spark.sql(_K, lineitem=lineitem))
        return self.spark.sql(_FRAG, k=k)

    @cached_property
    def reads(self) -> DataFrame:
        return self.spark.sql(_READS, frag=self.frag)

    def alignments(self, side: str) -> DataFrame:
        placed = self.spark.sql(_PLACED[side], reads=self.reads)
        return self.spark.sql(_aln_sql(side), placed=placed)

    @cached_property
    def master(self) -> DataFrame:
        """Alignments as a stored table, for queries that read them more than once."""
        return cut_lineage(self.alignments("m"))

    @cached_property
    def slave(self) -> DataFrame:
        return cut_lineage(self.alignments("s"))

    def at_hand(self, side: str) -> DataFrame:
        """Alignments to be read once: rebuilding the rows is less than storing them, unless other steps have stored them."""
        stored = self.__dict__.get("master" if side == "m" else "slave")
        return self.alignments(side) if stored is None else stored

    @contextmanager
    def short_alignments(self, side: str) -> Iterator[DataFrame]:
        """``master`` or ``slave`` for a while: stored at the entry, removed on leaving, unless it was there before."""
        name = "master" if side == "m" else "slave"
        if name in self.__dict__:
            yield self.__dict__[name]
            return
        with short_lived(self.alignments(side)) as table:
            self.__dict__[name] = table
            try:
                yield table
            finally:
                del self.__dict__[name]

    @cached_property
    def pairs(self) -> DataFrame:
        from contigloom.operators.reads import read_pairs, usable_reads

        return read_pairs(*[usable_reads(self.at_hand(side)) for side in "ms"])

    @cached_property
    def blocks(self) -> DataFrame:
        from contigloom.operators.blocks import blocks_by_islands

        return blocks_by_islands(self.pairs)

    @cached_property
    def merge_blocks(self) -> DataFrame:
        """Blocks of the merge steps: all of them."""
        return self.blocks

    def contigs(self, side: str) -> DataFrame:
        """Contig dictionary: every id up to the largest with an alignment."""
        return self._once("contigs", side, lambda: self._contigs(side))

    def _contigs(self, side: str) -> DataFrame:
        top = self.at_hand(side).agg(F.max("ctg").alias("top"))
        # two steps so that no single row expands into a long list
        outer = top.select("top", F.explode(F.sequence(F.lit(0), F.shiftright("top", 10))).alias("o"))
        ids = outer.select(
            "top", F.explode(F.sequence(F.col("o") * 1024, F.least("top", F.col("o") * 1024 + 1023))).alias("ctg_id")
        )
        return ids.select(
            F.col("ctg_id").cast("long").alias("ctg_id"),
            F.concat(F.lit(side), F.col("ctg_id").cast("string")).alias("name"),
            F.lit(M_LEN if side == "m" else S_LEN).cast("long").alias("length"),
        )

    def sequences(self, side: str) -> DataFrame:
        """(ctg_id, name, length, sequence) of an assembly."""
        return self._once("sequences", side, lambda: self._sequences(side))

    def _sequences(self, side: str) -> DataFrame:
        start = F.col("ctg_id") * (M_LEN if side == "m" else S_LEN) - (0 if side == "m" else S_SHIFT)
        df = spread(self.contigs(side), "ctg_id").withColumn("start", start)
        text = F.col("genome")
        if side == "s":
            text = F.when(F.col("ctg_id") % 2 == 1, F.reverse(F.translate(text, "ACGT", "TGCA"))).otherwise(text)
        return self.genome_pieces(df, "start", "length").select("ctg_id", "name", "length", text.alias("sequence"))

    @staticmethod
    def genome_pieces(df: DataFrame, start: str, length: str) -> DataFrame:
        """Add ``genome``: that stretch of it; 32-base chunks are hashes of their number."""
        shift = 3520  # keeps the coordinates of the first slave contig positive
        at = F.col(start) + shift
        lo, hi = F.shiftright(at, 5), F.shiftright(at + F.col(length) - 1, 5)
        chunks = F.transform(
            F.sequence(lo, hi),
            lambda i: F.translate(
                F.md5((i - shift // 32).cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"
            ),
        )
        text = F.substring(F.array_join(chunks, ""), (at - lo * 32 + 1).cast("int"), F.col(length).cast("int"))
        return df.withColumn("genome", text)

    def libraries(self) -> DataFrame:
        """Both libraries accept inserts of 90 to 500 bases."""
        return self.spark.range(2).select(
            F.col("id").cast("int").alias("lib_id"),
            F.lit(90).alias("min_isize"),
            F.lit(500).alias("max_isize"),
        )

    def library_stats(self, side: str) -> DataFrame:
        from contigloom.operators.reads import good_reads
        from contigloom.operators.stats import insert_size_stats

        aln = self.master if side == "m" else self.slave
        return insert_size_stats(good_reads(aln), self.libraries())
