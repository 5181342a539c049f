"""Derived tables tell the planner their size, and are stored no longer than they are read."""

import os

from contigloom.operators.reads import read_pairs, usable_reads
from contigloom.plans.catalog import queries
from contigloom.plans.fixture import Tables


def lineitem(spark, folder, n):
    rows = spark.range(n).selectExpr(
        "id div 4 AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "id % 199 AS l_partkey", "CAST(1 + id % 50 AS DOUBLE) AS l_quantity",
        "CAST(id % 10 AS DOUBLE) / 100 AS l_discount",
    )
    rows.write.parquet(f"{folder}/lineitem.parquet")


def test_long_sequences_are_not_broadcast(spark, tmp_path):
    lineitem(spark, tmp_path, 4000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    try:
        for name in ("bases_match", "subsequence"):
            plan = queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pairs_read_stored_alignments(spark, tmp_path):
    lineitem(spark, tmp_path, 4000)
    t = Tables(spark, str(tmp_path))
    stored = {f for aln in (t.master, t.slave) for f in aln.inputFiles()}
    assert set(t.pairs.inputFiles()) == stored
    # and without stored ones, the same rows
    again = Tables(spark, str(tmp_path)).pairs
    assert again.count() and again.exceptAll(t.pairs).isEmpty() and t.pairs.exceptAll(again).isEmpty()
    want = read_pairs(*[usable_reads(t.alignments(side)) for side in "ms"])
    assert want.exceptAll(t.pairs).isEmpty()


def test_contigs_alone_store_no_alignments(spark, tmp_path):
    lineitem(spark, tmp_path, 400)
    t = Tables(spark, str(tmp_path))
    ids = [{r.ctg_id for r in t.contigs(side).collect()} for side in "ms"]
    assert not {"master", "slave"} & set(t.__dict__)
    assert ids == [set(range(aln.agg({"ctg": "max"}).first()[0] + 1)) for aln in (t.master, t.slave)]


def test_alignments_for_a_while(spark, tmp_path):
    lineitem(spark, tmp_path, 400)
    t = Tables(spark, str(tmp_path))
    with t.short_alignments("m") as aln:
        files = [f.removeprefix("file://") for f in aln.inputFiles()]
        assert files and all(map(os.path.exists, files)) and t.at_hand("m") is aln
    assert not any(map(os.path.exists, files)) and "master" not in t.__dict__
    with t.short_alignments("m") as aln:
        assert aln.exceptAll(t.alignments("m")).isEmpty()
    kept = t.slave
    with t.short_alignments("s") as aln:
        assert aln is kept
    assert kept.count() == t.alignments("s").count()


def test_bases_of_records_are_made_after_the_shuffle(spark, tmp_path):
    from contigloom.plans.catalog_files import _records

    lineitem(spark, tmp_path, 400)
    t = Tables(spark, str(tmp_path))
    rows = _records(t.master)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("md5(") < plan.index("Exchange rangepartitioning") and "md5(" not in plan[plan.index("Exchange rangepartitioning"):]
    want = t.master.selectExpr("name", "ctg", "pos", "nh", "mctg", "len")
    got = rows.selectExpr("name", "ref_id AS ctg", "pos", "nh", "mate_ref_id AS mctg", "length(seq) AS len")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_windows_meet_and_are_aligned_where_they_are(spark, tmp_path):
    from contigloom.plans.catalog_merge import banded_alignment

    lineitem(spark, tmp_path, 4000)
    t = Tables(spark, str(tmp_path))
    rows = banded_alignment(t)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    bases = plan[plan.index("MapInPandas"):]
    assert bases.index("SortMergeJoin") < bases.index("ObjectHashAggregate") < bases.index("Exchange")
    # neither sequences beside their tiles nor alignments for the sake of the contigs
    assert ("sequences", "m") not in t._stored and not {"master", "slave"} & set(t.__dict__)
    assert rows.count() == t.blocks.count()
