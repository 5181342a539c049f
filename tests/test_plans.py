"""Both plans on the smallest tables, and a few queries against their oracle."""

import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from contigloom.plans import assembly_stats as stats_plan
from contigloom.plans import catalog, create_blocks
from contigloom.plans import merge_assemblies as ma
from contigloom.plans.fixture import Tables
from contigloom.session import cut_lineage
from contigloom.sinks import textfiles as sink
from contigloom.sources import textfiles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name", ["read_pairs", "frame_coverage", "min_cov_filter", "not_merged_slave", "relative_strand", "edge_region_score", "bam_roundtrip", "n50_stats"]
)
def test_query_matches_oracle(spark, name):
    ok, message = compare(spark, connect(SF), SF, catalog.queries()[name], catalog.oracle_sql()[name])
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_create_and_merge_from_files(spark, tmp_path):
    from contigloom.plans import from_files
    from contigloom.plans.catalog_files import _write

    t = Tables(spark, SF)
    for side, aln in (("m", t.master), ("s", t.slave)):
        for lib in (0, 1):
            _write(t, aln.where(F.col("lib_id") == lib), side, str(tmp_path / f"{side}{lib}"))
        (tmp_path / f"{side}.list").write_text("".join(f"{tmp_path / f'{side}{lib}'}\n90 500\n" for lib in (0, 1)))
        sink.write_contigs(t.sequences(side), str(tmp_path / f"{side}.fasta"))
    from_files.create(spark, str(tmp_path / "m.list"), str(tmp_path / "s.list"), str(tmp_path / "x"), 10)
    blocks = textfiles.read_blocks(spark, str(tmp_path / "x.blocks"), 5)
    assert blocks.count() == 25
    m, s = (from_files.assembly(spark, str(tmp_path / f"{x}.list"), str(tmp_path / f"x.{name}.isize"), str(tmp_path / f"{x}.fasta")) for x, name in (("m", "master"), ("s", "slave")))
    assert m.stats.count() == 2
    from_files.merge(str(tmp_path / "x.blocks"), m, s, str(tmp_path / "y"), 5)
    without = {r.s_ctg for r in t.slave.selectExpr("ctg AS s_ctg").distinct().collect()} - {r.s_ctg for r in blocks.collect()}
    names = lambda f: {r.name for r in textfiles.read_fasta(spark, str(tmp_path / f)).collect()}
    assert names("y.noblocks.BF.fasta") == {f"s{i}" for i in without}
    # the merged contigs spell the genome: every one is a stretch of the master contigs in order
    whole = "".join(r.sequence for r in m.contigs.orderBy("ctg_id").collect())
    merged = textfiles.read_fasta(spark, str(tmp_path / "y.fasta")).collect()
    assert all(r.sequence in whole for r in merged)
    assert sum(len(r.sequence) for r in merged) == len(whole)
    row = stats_plan.fasta_stats(spark, str(tmp_path / "y.fasta")).first()
    assert row.total == len(whole) and row.contigs == len(merged)
    assert "Linears = 1" in "".join(p.read_text() for p in (tmp_path / "y.stats").glob("part-*"))


def test_graph_tables_of_a_merge_are_not_broadcast(spark):
    from contigloom.operators import assembly_graph as ag
    from contigloom.operators import contig_sets as cs
    from contigloom.operators import forks as fk
    from contigloom.operators import merge as mg

    hull = spark.createDataFrame([(c, c, c, 10 * c, 10 * c) for c in range(6)], "chain long, m_ctg long, s_ctg long, m_begin long, s_begin long")
    vertices = fk.merge_vertices(hull)
    edges = spark.createDataFrame([(c, c + 1, "MASTER", 0.9) for c in range(5)], "src long, dst long, kind string, weight double")
    plans = {
        "paths": ag.chain_paths(vertices, edges),
        "lists": mg.merge_lists(vertices, edges),
        "chains": ag.vertex_hull(
            hull.selectExpr("chain AS vertex", "m_ctg", "s_ctg", "m_begin", "m_begin AS m_end", "s_begin", "s_begin AS s_end", "chain AS num_reads"),
            hull.selectExpr("chain AS vertex", "chain"),
        ),
        "unused": cs.unused_contigs(hull.selectExpr("chain AS ctg_id"), hull.where("chain > 3").selectExpr("chain AS ctg_id")),
    }
    for name, df in plans.items():
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), name
    assert {(r.vertex, r.head, r["rank"]) for r in plans["lists"].collect()} == {(c, 0, c) for c in range(6)}
    assert [r.ctg_id for r in plans["unused"].orderBy("ctg_id").collect()] == [0, 1, 2, 3]
