"""Registered queries on the contig graph, the assembly graph and read evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from contigloom.operators import assembly_graph as ag
from contigloom.operators import edges as ev
from contigloom.operators import strands as st
from contigloom.operators.reads import usable_reads  # noqa: F401
from contigloom.plans.fixture import M_LEN, S_LEN, Tables, oracle
from contigloom.plans.registry import long, query
from contigloom.session import cut_lineage

# -- contig graph -----------------------------------------------------------


@query("contig_pairs", oracle("SELECT DISTINCT m_ctg, s_ctg FROM b10", "b10"))
def contig_pairs(t: Tables):
    return ag.contig_pairs(t.merge_blocks)


_COMP = """lk AS (SELECT DISTINCT m_ctg * 2 AS u, s_ctg * 2 + 1 AS v FROM b10),
 lb AS (SELECT u, v FROM lk UNION ALL SELECT v, u FROM lk),
 reach AS (SELECT u AS a, u AS b FROM lb UNION SELECT r.a, l.v FROM reach r JOIN lb l ON l.u = r.b),
 comp AS (SELECT a AS vertex, CAST(min(CASE WHEN b % 2 = 0 THEN b END) / 2 AS BIGINT) AS component FROM reach GROUP BY a)"""
_VERTEX = "CASE WHEN vertex % 2 = 0 THEN 'm' ELSE 's' END AS asm, CAST((vertex - vertex % 2) / 2 AS BIGINT) AS ctg"


@query("contig_components", oracle(f"SELECT {_VERTEX}, component FROM comp", "b10", extra=_COMP, recursive=True))
def contig_components(t: Tables):
    return ag.contig_components(ag.contig_pairs(t.merge_blocks))


_STRAND = _COMP + """, evd AS (SELECT m_ctg, s_ctg, sum(CASE WHEN s_strand = '+' THEN num_reads ELSE 0 END) / sum(num_reads) AS p
 FROM b10 GROUP BY m_ctg, s_ctg),
 arc AS (SELECT m_ctg * 2 AS u, s_ctg * 2 + 1 AS v, p FROM evd UNION ALL SELECT s_ctg * 2 + 1, m_ctg * 2, p FROM evd),
 walk AS (SELECT DISTINCT component * 2 AS u, CAST(-1 AS BIGINT) AS prev, CAST(1 AS DOUBLE) AS prob FROM comp
 UNION ALL SELECT a.v, w.u, w.prob * a.p + (1 - w.prob) * (1 - a.p) FROM walk w JOIN arc a ON a.u = w.u AND a.v <> w.prev)"""


@query(
    "relative_strand",
    oracle(
        f"""SELECT {_VERTEX}, component, round(prob, 6) AS prob, CASE WHEN prob < 0.5 THEN '-' WHEN prob > 0.5 THEN '+' ELSE '?' END AS strand
 FROM walk JOIN comp ON comp.vertex = walk.u""",
        "b10", extra=_STRAND, recursive=True,
    ),
)
def relative_strand(t: Tables):
    return _strands(cut_lineage(t.merge_blocks)).withColumn("prob", F.round("prob", 6))


def _strands(blocks):
    comps = cut_lineage(ag.contig_components(ag.contig_pairs(blocks)))
    return st.relative_strands(st.strand_evidence(blocks), comps)


# -- assembly graph ---------------------------------------------------------

_VX = """vx AS (SELECT *, row_number() OVER (ORDER BY m_ctg, m_begin, m_end DESC, s_ctg, s_begin) - 1 AS vertex FROM b10),
 mn AS (SELECT vertex AS src, lead(vertex) OVER (PARTITION BY m_ctg ORDER BY m_begin, m_end DESC, s_ctg, s_begin) AS dst FROM vx),
 sn AS (SELECT CASE WHEN s_ctg % 2 = 1 THEN nx ELSE vertex END AS src, CASE WHEN s_ctg % 2 = 1 THEN vertex ELSE nx END AS dst FROM (
 SELECT vertex, s_ctg, lead(vertex) OVER (PARTITION BY s_ctg ORDER BY s_begin, s_end DESC, m_ctg, m_begin) AS nx FROM vx) q WHERE nx IS NOT NULL),
 ed AS (SELECT src, dst, CASE WHEN max(m) = 1 AND max(s) = 1 THEN 'BOTH' WHEN max(m) = 1 THEN 'MASTER' ELSE 'SLAVE' END AS kind FROM (
 SELECT src, dst, 1 AS m, 0 AS s FROM mn WHERE dst IS NOT NULL UNION ALL SELECT src, dst, 0, 1 FROM sn) e GROUP BY src, dst)"""


def _graph(t: Tables):
    """Numbered blocks with their component, and the ordering edges."""
    blocks = cut_lineage(t.merge_blocks)
    comps = cut_lineage(ag.contig_components(ag.contig_pairs(blocks)))
    strands = cut_lineage(st.relative_strands(st.strand_evidence(blocks), comps))
    vertices = cut_lineage(ag.number_blocks(ag.with_component(blocks, comps)))
    return vertices, cut_lineage(ag.assembly_edges(vertices, strands))


@query("assembly_edges", oracle("SELECT src, dst, kind FROM ed", "b10", extra=_VX))
def assembly_edges(t: Tables):
    return _graph(t)[1]


@query(
    "graph_degrees",
    oracle(
        """SELECT vertex, CAST((SELECT count(*) FROM ed WHERE dst = vertex) AS BIGINT) AS in_deg,
 CAST((SELECT count(*) FROM ed WHERE src = vertex) AS BIGINT) AS out_deg FROM vx""",
        "b10", extra=_VX,
    ),
)
def graph_degrees(t: Tables):
    return ag.degrees(*_graph(t))


_CLOSURE = f"""{_COMP}, {_VX}, path AS (SELECT src AS a, dst AS b FROM ed UNION SELECT p.a, e.dst FROM path p JOIN ed e ON e.src = p.b),
 way AS (SELECT a, b FROM path UNION ALL SELECT vertex, vertex FROM vx),
 place AS (SELECT v.vertex, c.component FROM vx v JOIN comp c ON c.vertex = v.m_ctg * 2),
 cyc AS (SELECT DISTINCT component FROM path JOIN place ON place.vertex = a WHERE a = b),
 bub AS (SELECT DISTINCT component FROM ed e1 JOIN ed e2 ON e1.src = e2.src AND e1.dst < e2.dst JOIN way w1 ON w1.a = e1.dst
 JOIN way w2 ON w2.a = e2.dst AND w2.b = w1.b JOIN place ON place.vertex = e1.src),
 frk AS (SELECT DISTINCT component FROM place WHERE vertex IN (SELECT src FROM ed GROUP BY src HAVING count(*) > 1)
 OR vertex IN (SELECT dst FROM ed GROUP BY dst HAVING count(*) > 1)),
 cls AS (SELECT DISTINCT component, CASE WHEN component IN (SELECT component FROM cyc) THEN 'cyclic' WHEN component IN
 (SELECT component FROM bub) THEN 'bubbles' WHEN component IN (SELECT component FROM frk) THEN 'forks' ELSE 'linear' END AS graph_class FROM place)"""


@query(
    "graph_class",
    oracle("SELECT component, graph_class FROM cls", "b10", extra=_CLOSURE, recursive=True),
)
def graph_class(t: Tables):
    return ag.graph_classes(*_graph(t))


@query(
    "graph_census",
    oracle(
        "SELECT graph_class, CAST(count(*) AS BIGINT) AS graphs FROM cls GROUP BY graph_class", "b10", extra=_CLOSURE, recursive=True
    ),
)
def graph_census(t: Tables):
    return ag.class_census(ag.graph_classes(*_graph(t)))


@query(
    "dag_test",
    oracle(
        "SELECT DISTINCT component, component NOT IN (SELECT component FROM cyc) AS acyclic FROM place",
        "b10", extra=_CLOSURE, recursive=True,
    ),
)
def dag_test(t: Tables):
    vertices, edges = _graph(t)
    own = vertices.select(F.col("vertex").alias("src"), F.col("component").alias("comp"))
    cyclic = ag.cyclic_components(edges.join(own, "src").select("comp", "src", "dst"))
    return (
        vertices.select("component").distinct()
        .join(cyclic.select(F.col("comp").alias("component"), F.lit(False).alias("ok")), "component", "left")
        .select("component", F.coalesce("ok", F.lit(True)).alias("acyclic"))
    )


_CHAIN = f"""{_VX}, run AS (SELECT vertex, max(CASE WHEN fresh THEN vertex END) OVER (ORDER BY vertex ROWS UNBOUNDED PRECEDING) AS chain FROM (
 SELECT vertex, NOT EXISTS (SELECT 1 FROM ed WHERE kind = 'BOTH' AND least(src, dst) = vertex - 1 AND greatest(src, dst) = vertex) AS fresh FROM vx) f)"""


@query("compact_graph", oracle("SELECT vertex, chain FROM run", "b10", extra=_CHAIN))
def compact_graph(t: Tables):
    return ag.compact_chains(*_graph(t))[0]


@query(
    "compact_edges",
    oracle(
        "SELECT a.chain AS src, b.chain AS dst, kind FROM ed JOIN run a ON a.vertex = ed.src JOIN run b ON b.vertex = ed.dst WHERE kind <> 'BOTH'",
        "b10", extra=_CHAIN,
    ),
)
def compact_edges(t: Tables):
    return ag.compact_chains(*_graph(t))[1]


@query(
    "vertex_hull",
    oracle(
        """SELECT chain, CAST(min(m_ctg) AS BIGINT) AS m_ctg, CAST(min(s_ctg) AS BIGINT) AS s_ctg, CAST(count(*) AS BIGINT) AS blocks,
 CAST(least(arg_min(m_begin, vx.vertex), arg_max(m_begin, vx.vertex)) AS BIGINT) AS m_begin, CAST(greatest(arg_min(m_end, vx.vertex),
 arg_max(m_end, vx.vertex)) AS BIGINT) AS m_end, CAST(least(arg_min(s_begin, vx.vertex), arg_max(s_begin, vx.vertex)) AS BIGINT) AS s_begin,
 CAST(greatest(arg_min(s_end, vx.vertex), arg_max(s_end, vx.vertex)) AS BIGINT) AS s_end FROM vx JOIN run ON run.vertex = vx.vertex GROUP BY chain""",
        "b10", extra=_CHAIN,
    ),
)
def vertex_hull(t: Tables):
    vertices, edges = _graph(t)
    hull = ag.vertex_hull(vertices, ag.compact_chains(vertices, edges)[0])
    return hull.select(*[long(c).alias(c) for c in ("chain", "m_ctg", "s_ctg", "blocks", "m_begin", "m_end", "s_begin", "s_end")])


@query(
    "chain_ranks",
    oracle(
        """SELECT v AS vertex, head, CAST(rank AS BIGINT) AS rank FROM walk""",
        "b10",
        extra=_VX + """, walk AS (SELECT vertex AS v, vertex AS head, 0 AS rank FROM vx WHERE vertex NOT IN (SELECT dst FROM ed)
 UNION ALL SELECT ed.dst, head, rank + 1 FROM walk JOIN ed ON ed.src = walk.v)""",
        recursive=True,
    ),
)
def chain_ranks(t: Tables):
    return ag.chain_paths(*_graph(t))


# -- read evidence ----------------------------------------------------------

_EDGE = f"""{_VX}, eg AS (SELECT ed.src, ed.dst, ed.kind, CASE WHEN kind = 'MASTER' THEN a.m_ctg ELSE a.s_ctg END AS ctg,
 CASE WHEN kind = 'MASTER' THEN a.m_begin ELSE a.s_begin END AS b1, CASE WHEN kind = 'MASTER' THEN a.m_end ELSE a.s_end END AS e1,
 CASE WHEN kind = 'MASTER' THEN b.m_begin ELSE b.s_begin END AS b2, CASE WHEN kind = 'MASTER' THEN b.m_end ELSE b.s_end END AS e2,
 CASE WHEN kind = 'MASTER' THEN 10000 ELSE 7000 END AS slen FROM ed JOIN vx a ON a.vertex = ed.src JOIN vx b ON b.vertex = ed.dst WHERE kind <> 'BOTH'),
 lb AS (SELECT 'MASTER' AS kind, lib_id, CAST(floor(mu) + 3 * floor(sd) AS BIGINT) AS maxi FROM libs UNION ALL
 SELECT 'SLAVE', lib_id, CAST(floor(mu) + 3 * floor(sd) AS BIGINT) FROM libs_s),
 w0 AS (SELECT eg.*, lib_id, maxi, (b1 <= b2 AND e1 >= e2) OR (b2 <= b1 AND e2 >= e1) AS contained,
 CASE WHEN b1 <= b2 THEN b2 - e1 + 1 ELSE b1 - e2 + 1 END AS gap FROM eg JOIN lb ON lb.kind = eg.kind),
 w1 AS (SELECT *, CASE WHEN b1 <= b2 THEN CASE WHEN gap >= 0 THEN b2 ELSE e1 END ELSE CASE WHEN gap >= 0 THEN b1 ELSE e2 END END AS far,
 CASE WHEN b1 <= b2 THEN CASE WHEN gap >= 0 THEN e1 ELSE b2 END ELSE CASE WHEN gap >= 0 THEN e2 ELSE b1 END END AS s2 FROM w0),
 w2 AS (SELECT *, greatest(far - maxi, 0) AS s1 FROM w1),
 w3 AS (SELECT *, NOT contained AND slen - s1 >= maxi AND gap < maxi AND s2 >= s1 AS scored FROM w2),
 rd AS (SELECT 'MASTER' AS kind, * FROM um WHERE (flag & 1) <> 0 AND (flag & 16) = 0 UNION ALL
 SELECT 'SLAVE', * FROM us WHERE (flag & 1) <> 0 AND (flag & 16) = 0),
 hit AS (SELECT w.src, w.dst, w.lib_id, least(r.epos - 1, w.s2) - r.pos + 1 AS ov, (r.flag & 8) <> 0 AS lost,
 (r.flag & 8) = 0 AND r.ctg <> r.mctg AS away, r.pos + w.maxi < w.slen AS room, (r.flag & 8) = 0 AND r.ctg = r.mctg AND r.mpos + r.epos - r.pos - 1 >= w.far AS crs,
 (r.flag & 32) <> 0 AS facing FROM w3 w JOIN rd r ON r.kind = w.kind AND r.lib_id = w.lib_id AND r.ctg = w.ctg AND r.pos BETWEEN w.s1 AND w.s2 WHERE w.scored),
 tal AS (SELECT src, dst, lib_id, sum(CASE WHEN lost OR away OR crs THEN 1 ELSE 0 END) AS num,
 sum(CASE WHEN lost OR (away AND room) OR crs THEN ov ELSE 0 END) AS ex, sum(CASE WHEN crs AND facing THEN ov ELSE 0 END) AS gd FROM hit GROUP BY src, dst, lib_id),
 sc AS (SELECT w.src, w.dst, w.kind, w.lib_id, CASE WHEN contained THEN -1.0 WHEN NOT scored THEN -4.0 WHEN num >= 10 AND ex > 0 THEN gd / ex ELSE -5.0 END AS score,
 CAST(CASE WHEN scored AND num >= 10 AND ex > 0 THEN num ELSE 0 END AS BIGINT) AS num FROM w3 w LEFT JOIN tal ON tal.src = w.src AND tal.dst = w.dst AND tal.lib_id = w.lib_id)"""
_EDGE_TABLES = ("b10", "um", "us", "libs", "libs_s")


def _edge_regions(t: Tables, vertices, edges, side: str):
    kind, length = ("MASTER", M_LEN) if side == "m" else ("SLAVE", S_LEN)
    frame = [f"{side}_ctg", f"{side}_begin", f"{side}_end"]
    a = vertices.select(F.col("vertex").alias("src"), *[F.col(c).alias(f"r1{c[1:]}") for c in frame])
    b = vertices.select(F.col("vertex").alias("dst"), *[F.col(c).alias(f"r2{c[1:]}") for c in frame[1:]])
    return (
        edges.where(F.col("kind") == kind).join(a, "src").join(b, "dst")
        .select(
            F.struct("src", "dst").alias("edge_id"), F.col("r1_ctg").alias("ctg"),
            "r1_begin", "r1_end", "r2_begin", "r2_end", F.lit(length).alias("seq_len"),
        )
    )


def _library_scores(t: Tables):
    vertices, edges = _graph(t)
    sides = [
        ev.library_edge_scores(_edge_regions(t, vertices, edges, side), aln, t.library_stats(side))
        for side, aln in (("m", t.master), ("s", t.slave))
    ]
    return cut_lineage(sides[0].unionByName(sides[1]))


@query(
    "edge_region_score",
    oracle(
        """SELECT src, dst, round(arg_max(score, num * 10 - lib_id), 6) AS weight, CAST(max(num) AS BIGINT) AS rnum FROM sc GROUP BY src, dst""",
        *_EDGE_TABLES, extra=_EDGE,
    ),
)
def edge_region_score(t: Tables):
    best = ev.best_library(_library_scores(t))
    return best.select("edge_id.src", "edge_id.dst", F.round("weight", 6).alias("weight"), long("rnum").alias("rnum"))


_COMBINED = _EDGE + """, pm AS (SELECT p.src, p.dst, p.kind, p.score AS pw, p.num AS pn, m.score AS mw, m.num AS mn FROM sc p JOIN sc m
 ON m.src = p.src AND m.dst = p.dst AND p.lib_id = 0 AND m.lib_id = 1),
 cmb AS (SELECT *, CASE WHEN pn < 10 AND mn < 10 THEN -5.0 WHEN mn < 10 THEN pw WHEN pn < 10 THEN mw WHEN pw > mw THEN pw ELSE mw END AS weight,
 CASE WHEN pn < 10 AND mn < 10 THEN 0 WHEN mn < 10 THEN pn WHEN pn < 10 THEN mn WHEN pw > mw THEN pn ELSE mn END AS rnum FROM pm)"""


def _pe_mp(t: Tables):
    """Library 0 as the paired-end, library 1 as the mate-pair library."""
    scores = _library_scores(t).select("edge_id.src", "edge_id.dst", "lib_id", "score", "num")
    pe = scores.where("lib_id = 0").select("src", "dst", F.col("score").alias("pw"), F.col("num").alias("pn"))
    mp = scores.where("lib_id = 1").select("src", "dst", F.col("score").alias("mw"), F.col("num").alias("mn"))
    both = pe.join(mp, ["src", "dst"])
    weight, rnum = ev.combine_libraries(F.col("pw"), F.col("pn"), F.col("mw"), F.col("mn"))
    return both.withColumn("weight", weight).withColumn("rnum", rnum.cast("long"))


@query(
    "edge_pe_mp_combine",
    oracle("SELECT src, dst, round(weight, 6) AS weight, CAST(rnum AS BIGINT) AS rnum FROM cmb", *_EDGE_TABLES, extra=_COMBINED),
)
def edge_pe_mp_combine(t: Tables):
    return _pe_mp(t).select("src", "dst", F.round("weight", 6).alias("weight"), "rnum")


@query(
    "safe_edge",
    oracle(
        "SELECT src, dst, (weight >= 0 AND weight < 0.3) AS safe FROM cmb", *_EDGE_TABLES, extra=_COMBINED,
    ),
)
def safe_edge(t: Tables):
    return _pe_mp(t).select("src", "dst", ev.safe_edge(F.col("weight"), F.lit(False)).alias("safe"))


@query(
    "fork_class",
    oracle(
        """SELECT src, dst, CASE WHEN pw < 0 OR mw < 0 THEN 'UNDECIDED' WHEN abs(pw - mw) >= 0.8 AND pw >= mw THEN 'MIS_SLAVE'
 WHEN abs(pw - mw) >= 0.8 THEN 'MIS_MASTER' ELSE 'UNKNOWN' END AS fork_class FROM cmb""",
        *_EDGE_TABLES, extra=_COMBINED,
    ),
)
def fork_class(t: Tables):
    """The two library weights stand in for the master and slave weight of a fork."""
    return _pe_mp(t).select("src", "dst", ev.fork_class(F.col("pw"), F.col("mw")).alias("fork_class"))


@query(
    "region_zscore",
    oracle(
        """SELECT r.m_ctg, r.s_ctg, CAST(r.m_begin AS BIGINT) AS m_begin, CAST(l.lib_id AS BIGINT) AS lib_id, CAST(coalesce(x.n, 0) AS BIGINT) AS inserts,
 round(CASE WHEN coalesce(x.n, 0) > 5 AND sd > 0 THEN (tot / x.n - mu) / (sd / sqrt(x.n)) ELSE 0.0 END, 6) AS z FROM b10 r CROSS JOIN libs l LEFT JOIN (
 SELECT b.m_ctg, b.s_ctg, b.m_begin, i.lib_id, count(*) AS n, sum(i.isize) AS tot FROM b10 b JOIN ins i ON i.ctg = b.m_ctg AND i.pos >= b.m_begin
 AND i.epos - 1 <= b.m_end AND i.mpos >= b.m_begin AND i.mpos + i.epos - i.pos - 1 <= b.m_end GROUP BY b.m_ctg, b.s_ctg, b.m_begin, i.lib_id) x
 ON x.m_ctg = r.m_ctg AND x.s_ctg = r.s_ctg AND x.m_begin = r.m_begin AND x.lib_id = l.lib_id""",
        "b10", "um", "libs",
        extra="""ins AS (SELECT * FROM (SELECT u.lib_id, ctg, pos, epos, mpos, mu, sd, CASE WHEN pos < mpos THEN mpos + epos - 2 * pos ELSE epos - mpos END AS isize
 FROM um u JOIN libs ON libs.lib_id = u.lib_id WHERE (flag & 64) <> 0 AND (flag & 8) = 0 AND ctg = mctg) q
 WHERE isize BETWEEN CASE WHEN mu > 3 * sd THEN floor(mu - 3 * sd) ELSE 0 END AND floor(mu + 3 * sd))""",
    ),
)
def region_zscore(t: Tables):
    regions = cut_lineage(t.merge_blocks).select(
        F.struct("m_ctg", "s_ctg", "m_begin").alias("region_id"),
        F.col("m_ctg").alias("ctg"), F.col("m_begin").alias("begin"), F.col("m_end").alias("end"),
    )
    stats = cut_lineage(t.library_stats("m"))
    z = ev.region_zscores(regions, t.master, stats)
    return z.select(
        "region_id.m_ctg", "region_id.s_ctg", long("region_id.m_begin").alias("m_begin"), long("lib_id").alias("lib_id"),
        long("inserts").alias("inserts"), F.round("z", 6).alias("z"),
    )
