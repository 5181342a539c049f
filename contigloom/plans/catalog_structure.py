"""Registered queries on rearranged assemblies: rings, bubbles, forks, cycles and contradicting strands.

Stretches of ``lineitem`` (16 order numbers each) are the blocks.  Twelve make a
neighbourhood of four master contigs with three blocks each; six slave contigs
hold two of these blocks each, in one of eight arrangements.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contigloom.operators import assembly_graph as ag
from contigloom.operators import forks as fk
from contigloom.operators import regions
from contigloom.operators import strands as st
from contigloom.plans.fixture import Tables, oracle
from contigloom.plans.registry import query
from contigloom.session import cut_lineage
from contigloom.sinks import textfiles as sink

#: The two blocks on each slave contig, by arrangement.
ARRANGEMENTS = [
    [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11)],  # as in the master
    [(0, 2), (1, 3), (4, 5), (6, 8), (7, 9), (10, 11)],  # a block is skipped: bubbles
    [(2, 0), (1, 3), (4, 5), (8, 6), (7, 9), (10, 11)],  # a step back: cycles
    [(0, 4), (1, 2), (6, 10), (7, 8), (3, 11), (9, 5)],  # forks that do not meet again
    [(0, 3), (1, 4), (2, 5), (6, 9), (7, 10), (8, 11)],  # two master contigs over three slave contigs: rings
    [(2, 3), (5, 6), (8, 9), (11, 0), (1, 4), (7, 10)],  # a ring of all master contigs
    [(0, 5), (10, 3), (8, 1), (6, 11), (4, 9), (2, 7)],  # rings that share contigs
    [(1, 0), (3, 2), (5, 4), (7, 6), (9, 8), (11, 10)],  # slave contigs the other way round
]
_PLACES = ", ".join(f"({c}, {i}, {2 * p + h})" for c, pairs in enumerate(ARRANGEMENTS) for p, pair in enumerate(pairs) for h, i in enumerate(pair))
_STRETCH = """SELECT k, CAST(count(*) AS BIGINT) AS num_reads, CAST(sum(l_quantity) AS BIGINT) AS q FROM (
 SELECT CAST((l_orderkey - l_orderkey % 16) / 16 AS BIGINT) AS k, l_quantity FROM {lineitem}) x GROUP BY k"""
_BLOCKS = f"""SELECT k AS vertex, m_ctg, m_begin, m_begin + 899 AS m_end, s_ctg, s_back, CASE WHEN s_back THEN 1000 - half * 1000 ELSE half * 1000 END AS s_begin,
 CASE WHEN s_back THEN 1899 - half * 1000 ELSE half * 1000 + 899 END AS s_end, num_reads, q,
 CASE WHEN s_back = (k % 7 = 3) THEN '+' ELSE '-' END AS s_strand FROM (
 SELECT k, num_reads, q, CAST((k - k % 3) / 3 AS BIGINT) AS m_ctg, (k % 3) * 1000 AS m_begin,
 CAST((k - k % 12) / 2 + (j - j % 2) / 2 AS BIGINT) AS s_ctg, CAST(j % 2 AS BIGINT) AS half,
 ((k - k % 12) / 2 + (j - j % 2) / 2) % 3 = 1 OR cls = 7 AS s_back
 FROM {{stretch}} s JOIN (VALUES {_PLACES}) AS p(cls, i, j) ON k % 12 = i AND ((k - k % 12) / 12) % 8 = cls) y"""
_CTES = f"""str AS ({_STRETCH.format(lineitem="lineitem")}), sb AS ({_BLOCKS.format(stretch="str")}),
 lk AS (SELECT DISTINCT m_ctg * 2 AS a, s_ctg * 2 + 1 AS b FROM sb),
 lb AS (SELECT a AS u, b AS v FROM lk UNION ALL SELECT b, a FROM lk),
 reach AS (SELECT u AS a, u AS b FROM lb UNION SELECT r.a, l.v FROM reach r JOIN lb l ON l.u = r.b),
 comp AS (SELECT a AS vertex, CAST(min(CASE WHEN b % 2 = 0 THEN b END) / 2 AS BIGINT) AS component FROM reach GROUP BY a)"""


def _sql(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join((_CTES, *ctes))} {body}"


def _blocks(t: Tables):
    lineitem = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet")
    return cut_lineage(t.spark.sql(_BLOCKS, stretch=t.spark.sql(_STRETCH, lineitem=lineitem)))


def _components(blocks):
    return cut_lineage(ag.contig_components(ag.contig_pairs(blocks)))


_VERTEX = "CASE WHEN vertex % 2 = 0 THEN 'm' ELSE 's' END AS asm, CAST((vertex - vertex % 2) / 2 AS BIGINT) AS ctg"


@query("structured_components", _sql(f"SELECT {_VERTEX}, component FROM comp"))
def structured_components(t: Tables):
    return _components(_blocks(t))


#: Explicit paths: the best tree by "no path of better edges", blocks by shared rings, then every way of a contig.
_RINGS = """e AS (SELECT m_ctg * 2 AS a, s_ctg * 2 + 1 AS b, sum(CASE WHEN s_strand = '+' THEN num_reads ELSE -num_reads END)::DOUBLE / sum(num_reads) AS x,
 sum(num_reads)::BIGINT AS w FROM sb GROUP BY m_ctg, s_ctg),
 rb AS (SELECT a AS fa, b AS fb, w AS fw, a AS spot FROM e UNION SELECT fa, fb, fw, CASE WHEN e.a = spot THEN e.b ELSE e.a END FROM rb JOIN e ON (e.a = spot OR e.b = spot)
 AND (e.w > fw OR (e.w = fw AND (e.a < fa OR (e.a = fa AND e.b < fb))))),
 ch AS (SELECT e.* FROM e JOIN rb ON rb.fa = e.a AND rb.fb = e.b AND rb.spot = e.b),
 tr AS (SELECT * FROM e ANTI JOIN ch ON ch.a = e.a AND ch.b = e.b),
 ta AS (SELECT a AS u, b AS v, x, w FROM tr UNION ALL SELECT b, a, x, w FROM tr),
 tw AS (SELECT DISTINCT component * 2 AS v, CAST(-1 AS BIGINT) AS parent, []::BIGINT[] AS path, CAST(1 AS DOUBLE) AS x, CAST(0 AS BIGINT) AS w FROM comp
 UNION ALL SELECT ta.v, tw.v, list_append(path, ta.v), ta.x, ta.w FROM tw JOIN ta ON ta.u = tw.v AND ta.v <> tw.parent),
 rp AS (SELECT ch.a, ch.b, ch.x, ch.w, p.path AS pa, q.path AS pb FROM ch JOIN tw p ON p.v = ch.a JOIN tw q ON q.v = ch.b),
 rg AS (SELECT a, b, x, w, pa, pb, unnest(list_filter(list_concat(pa, pb), lambda u: NOT (list_contains(pa, u) AND list_contains(pb, u)))) AS v FROM rp),
 bl AS (SELECT v AS one, v AS two FROM tw WHERE parent >= 0 UNION SELECT bl.one, r.v FROM bl JOIN rg l ON l.v = bl.two JOIN rg r ON r.a = l.a AND r.b = l.b),
 bk AS (SELECT one AS v, min(two) AS block FROM bl GROUP BY one),
 st AS (SELECT v, block, unnest(path) AS u FROM tw JOIN bk USING (v)),
 op AS (SELECT st.v, st.u, len(tw.path) AS nth, tw.parent, tw.x, tw.w FROM st JOIN bk ON bk.v = st.u AND bk.block = st.block JOIN tw ON tw.v = st.u),
 en AS (SELECT v, arg_min(parent, nth) AS entry FROM op GROUP BY v),
 wy AS (SELECT v, product(x) AS x, min(w) AS w FROM op GROUP BY v UNION ALL
 SELECT v, product(x), min(w) FROM (SELECT a, b, v, x, w FROM rg UNION ALL
 SELECT r.a, r.b, r.v, t.x, t.w FROM (SELECT rg.a, rg.b, rg.v, bk.block, unnest(CASE WHEN list_contains(pa, rg.v) THEN pb ELSE pa END) AS u FROM rg JOIN bk ON bk.v = rg.v) r
 JOIN bk ON bk.v = r.u AND bk.block = r.block JOIN tw t ON t.v = r.u UNION ALL
 SELECT r.a, r.b, r.v, t.x, t.w FROM (SELECT a, b, v, unnest(CASE WHEN list_contains(pa, v) THEN pa[list_position(pa, v) + 1:] ELSE pb[list_position(pb, v) + 1:] END) AS u FROM rg) r
 JOIN tw t ON t.v = r.u) f GROUP BY a, b, v),
 mn AS (SELECT wy.v, entry, sum(x * w) / sum(w) AS m FROM wy JOIN en USING (v) GROUP BY wy.v, entry),
 yy AS (SELECT DISTINCT component * 2 AS vertex, CAST(1 AS DOUBLE) AS y FROM comp UNION ALL SELECT mn.v, y * m FROM yy JOIN mn ON mn.entry = yy.vertex)"""


@query(
    "ring_strands",
    _sql(
        f"""SELECT {_VERTEX}, component, round((1 + y) / 2, 6) AS prob, CASE WHEN round((1 + y) / 2, 12) < 0.5 THEN '-' WHEN round((1 + y) / 2, 12) > 0.5 THEN '+' ELSE '?' END AS strand
 FROM yy JOIN comp USING (vertex)""",
        _RINGS,
    ),
)
def ring_strands(t: Tables):
    """Strands where several ways lead to a contig and say different things."""
    blocks = _blocks(t)
    return st.relative_strands(st.strand_evidence(blocks), _components(blocks)).withColumn("prob", F.round("prob", 6))


_EDGES = """mn0 AS (SELECT vertex AS src, lead(vertex) OVER (PARTITION BY m_ctg ORDER BY m_begin) AS dst FROM sb),
 sn0 AS (SELECT vertex, s_back, lead(vertex) OVER (PARTITION BY s_ctg ORDER BY s_begin) AS nx FROM sb),
 ed AS (SELECT src, dst, CASE WHEN max(m) = 1 AND max(s) = 1 THEN 'BOTH' WHEN max(m) = 1 THEN 'MASTER' ELSE 'SLAVE' END AS kind FROM (
 SELECT src, dst, 1 AS m, 0 AS s FROM mn0 WHERE dst IS NOT NULL UNION ALL
 SELECT CASE WHEN s_back THEN nx ELSE vertex END, CASE WHEN s_back THEN vertex ELSE nx END, 0, 1 FROM sn0 WHERE nx IS NOT NULL) x GROUP BY src, dst)"""
_CLOSED = _EDGES + """, path AS (SELECT src AS a, dst AS b FROM ed UNION SELECT p.a, e.dst FROM path p JOIN ed e ON e.src = p.b),
 way AS (SELECT a, b FROM path UNION ALL SELECT vertex, vertex FROM sb),
 place AS (SELECT v.vertex, c.component FROM sb v JOIN comp c ON c.vertex = v.m_ctg * 2),
 cyc AS (SELECT DISTINCT component FROM path JOIN place ON place.vertex = a WHERE a = b),
 bub AS (SELECT DISTINCT component FROM ed e1 JOIN ed e2 ON e1.src = e2.src AND e1.dst < e2.dst JOIN way w1 ON w1.a = e1.dst
 JOIN way w2 ON w2.a = e2.dst AND w2.b = w1.b JOIN place ON place.vertex = e1.src),
 frk AS (SELECT DISTINCT component FROM place WHERE vertex IN (SELECT src FROM ed GROUP BY src HAVING count(*) > 1)
 OR vertex IN (SELECT dst FROM ed GROUP BY dst HAVING count(*) > 1)),
 cls AS (SELECT DISTINCT component, CASE WHEN component IN (SELECT component FROM cyc) THEN 'cyclic' WHEN component IN
 (SELECT component FROM bub) THEN 'bubbles' WHEN component IN (SELECT component FROM frk) THEN 'forks' ELSE 'linear' END AS graph_class FROM place)"""


def _graph(t: Tables):
    """Blocks with their component, and ordering edges under the strands the slave contigs were laid out in."""
    blocks = _blocks(t)
    back = blocks.select(F.lit("s").alias("asm"), F.col("s_ctg").alias("ctg"), F.when(F.col("s_back"), "-").otherwise("+").alias("strand"))
    ahead = blocks.select(F.lit("m").alias("asm"), F.col("m_ctg").alias("ctg"), F.lit("+").alias("strand"))
    vertices = cut_lineage(ag.with_component(blocks, _components(blocks)))
    return vertices, cut_lineage(ag.assembly_edges(vertices, back.unionByName(ahead).distinct()))


@query("structured_edges", _sql("SELECT src, dst, kind FROM ed", _EDGES))
def structured_edges(t: Tables):
    return _graph(t)[1]


@query(
    "structured_degrees",
    _sql(
        """SELECT vertex, CAST(coalesce(i, 0) AS BIGINT) AS in_deg, CAST(coalesce(o, 0) AS BIGINT) AS out_deg FROM sb
 LEFT JOIN (SELECT dst AS vertex, count(*) AS i FROM ed GROUP BY dst) x USING (vertex) LEFT JOIN (SELECT src AS vertex, count(*) AS o FROM ed GROUP BY src) y USING (vertex)""",
        _EDGES,
    ),
)
def structured_degrees(t: Tables):
    return ag.degrees(*_graph(t))


@query("structured_classes", _sql("SELECT component, graph_class FROM cls", _CLOSED))
def structured_classes(t: Tables):
    """All four classes occur."""
    return ag.graph_classes(*_graph(t))


@query("structured_census", _sql("SELECT graph_class, CAST(count(*) AS BIGINT) AS graphs FROM cls GROUP BY graph_class", _CLOSED))
def structured_census(t: Tables):
    return ag.class_census(ag.graph_classes(*_graph(t)))


@query(
    "structured_dag_test",
    _sql("SELECT DISTINCT component, component NOT IN (SELECT component FROM cyc) AS acyclic FROM place", _CLOSED),
)
def structured_dag_test(t: Tables):
    vertices, edges = _graph(t)
    own = vertices.select(F.col("vertex").alias("src"), F.col("component").alias("comp"))
    cyclic = ag.cyclic_components(edges.join(own, "src").select("comp", "src", "dst"))
    found = cyclic.select(F.col("comp").alias("component"), F.lit(False).alias("ok"))
    return vertices.select("component").distinct().join(found, "component", "left").select("component", F.coalesce("ok", F.lit(True)).alias("acyclic"))


@query("structured_forks")
def structured_forks(t: Tables):
    """Forks resolved by weights from 0 to 1 (and unknown ones) in the acyclic components; see tests/test_forks.py."""
    vertices, edges = _graph(t)
    own = vertices.select("vertex", F.col("component").alias("comp"))
    cyclic = cut_lineage(ag.cyclic_components(edges.join(own.withColumnRenamed("vertex", "src"), "src").select("comp", "src", "dst")))
    own = cut_lineage(own.join(cyclic, "comp", "left_anti"))
    hull = vertices.join(own.select("vertex"), "vertex", "left_semi").select(F.col("vertex").alias("chain"), "m_ctg", "s_ctg", "m_begin", "s_begin")
    sums = vertices.select("vertex", "q")
    mixed = (F.col("q_src") * 31 + F.col("q_dst") * 17) % 23
    weighted = (
        edges.where("kind <> 'BOTH'")
        .join(own.select(F.col("vertex").alias("src")), "src", "left_semi")
        .join(sums.select(F.col("vertex").alias("src"), F.col("q").alias("q_src")), "src")
        .join(sums.select(F.col("vertex").alias("dst"), F.col("q").alias("q_dst")), "dst")
        .select("src", "dst", "kind", F.when(mixed > 20, -5.0).otherwise(mixed / 20).alias("weight"))
    )
    left, _ = fk.resolve_forks(fk.merge_vertices(hull), weighted, own)
    return left.select("vertex", "m_ctg", "s_ctg", "valid", "m_ltail", "m_rtail", "s_ltail", "s_rtail")


def _reach_sql(start: str, other: str) -> str:
    return _sql(
        f"""SELECT DISTINCT {start} AS start, 'm' AS asm, m_ctg AS ctg FROM way JOIN sb ON vertex = {other} UNION ALL
 SELECT DISTINCT {start}, 's', s_ctg FROM way JOIN sb ON vertex = {other}""",
        _CLOSED,
    )


@query("next_contigs", _reach_sql("a", "b"))
def next_contigs(t: Tables):
    """What can be reached from every block, through forks, bubbles and cycles."""
    vertices, edges = _graph(t)
    return ag.next_contigs(vertices, edges, vertices)


@query("previous_contigs", _reach_sql("b", "a"))
def previous_contigs(t: Tables):
    vertices, edges = _graph(t)
    return ag.next_contigs(vertices, ag.reversed_edges(edges), vertices)


_TOTALS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("m_start", "m_last", "s_start", "s_last", "mate"))


@query(
    "read_pair_sums",
    oracle(f"SELECT m_ctg, s_ctg, CAST(count(*) AS BIGINT) AS pairs, {_TOTALS}, CAST(sum(CASE WHEN concordant THEN 1 ELSE 0 END) AS BIGINT) AS concordant FROM pairs GROUP BY m_ctg, s_ctg", "pairs"),
)
def read_pair_sums(t: Tables):
    """The read pairs of every pair of contigs, counted and summed."""
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("m_start", "m_last", "s_start", "s_last", "mate")]
    return t.pairs.groupBy("m_ctg", "s_ctg").agg(F.count("*").alias("pairs"), *sums, F.sum(F.col("concordant").cast("long")).alias("concordant"))


@query(
    "region_join_sums",
    oracle(
        """SELECT CAST(b.m_ctg AS BIGINT) AS m_ctg, CAST(b.s_ctg AS BIGINT) AS s_ctg, CAST(b.m_begin AS BIGINT) AS m_begin, CAST(count(*) AS BIGINT) AS reads,
 CAST(sum(r.pos) AS BIGINT) AS pos, CAST(sum(r.mate) AS BIGINT) AS mate FROM b10 b JOIN am r ON r.ctg = b.m_ctg AND r.pos < b.m_end + 1 AND r.epos > b.m_begin
 GROUP BY b.m_ctg, b.s_ctg, b.m_begin""",
        "b10", "am",
    ),
)
def region_join_sums(t: Tables):
    """The reads that overlap each block's master frame, counted and summed."""
    frames = t.merge_blocks.select(F.col("m_ctg").alias("ctg"), "s_ctg", F.col("m_begin").alias("begin"), F.col("m_end").alias("end"))
    hits = regions.region_join(frames, t.master.select("name", "mate", "ctg", "pos", "epos"))
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("pos", "mate")]
    return hits.groupBy(F.col("ctg").alias("m_ctg"), "s_ctg", F.col("begin").cast("long").alias("m_begin")).agg(F.count("*").alias("reads"), *sums)


@query(
    "structured_dot",
    _sql(
        """SELECT component AS comp, CAST(ord AS BIGINT) AS ord, value FROM (
 SELECT DISTINCT component, 0 AS ord, concat('digraph AssemblyGraph_', CAST(component AS VARCHAR), ' {') AS value FROM place UNION ALL
 SELECT DISTINCT component, 3, '}' FROM place UNION ALL
 SELECT component, 1, concat('   ', CAST(sb.vertex AS VARCHAR), '[label="<0,', CAST(m_ctg AS VARCHAR), '> :', CAST(m_begin AS VARCHAR), ':900 (', printf('%.2f', CAST(num_reads AS DOUBLE) / 900), '/',
 printf('%.2f', CAST(num_reads + q AS DOUBLE) / 900), ')\\n<0,', CAST(s_ctg AS VARCHAR), '> :', CAST(s_begin AS VARCHAR), ':900 (', printf('%.2f', CAST(num_reads AS DOUBLE) / 900), '/',
 printf('%.2f', CAST(num_reads + q AS DOUBLE) / 900), ')"', CASE WHEN sb.vertex IN (SELECT src FROM ed GROUP BY src HAVING count(*) > 1) OR sb.vertex IN (SELECT dst FROM ed GROUP BY dst HAVING count(*) > 1)
 THEN ', color=deepskyblue, style=filled];' ELSE '];' END) FROM sb JOIN place ON place.vertex = sb.vertex UNION ALL
 SELECT component, 2, concat('   ', CAST(src AS VARCHAR), '->', CAST(dst AS VARCHAR), '[color=', CASE kind WHEN 'MASTER' THEN 'black' WHEN 'SLAVE' THEN 'red' ELSE 'green' END, ', label="0"];')
 FROM ed JOIN place ON place.vertex = src) x""",
        _CLOSED,
    ),
)
def structured_dot(t: Tables):
    """Lines of the block graphs' files, forking blocks coloured; read lengths are the counts of the stretch."""
    vertices, edges = _graph(t)
    reads = {f"{side}_{c}": F.col("num_reads") + (F.col("q") if c == "reads_len" else 0) for side in ("m", "s") for c in ("block_reads_len", "reads_len")}
    vertices = cut_lineage(vertices.withColumns(reads))
    return sink.assembly_dot(vertices, edges, ag.degrees(vertices, edges)).select("comp", F.col("ord").cast("long").alias("ord"), "value")
