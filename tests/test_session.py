"""Stored tables leave no shuffle files, and short-lived ones no files."""

import glob
import os
import time

from pyspark.sql import functions as F

from contigloom.operators import coverage as cv
from contigloom.operators import reads as R
from contigloom.operators import tiled as T
from contigloom.session import cut_lineage, freed_shuffles, result_only, shared_folder, short_lived

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark) -> set[str]:
    """Names of the shuffle files on the disks of the session."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {os.path.basename(f) for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def _gone(spark, before: set[str]) -> bool:
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def _grouped(spark):
    return spark.range(2000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))


def test_a_stored_table_frees_its_shuffles(spark):
    df, setting, before = _grouped(spark), spark.conf.get(KEY), _shuffle_files(spark)
    table = cut_lineage(df)
    assert _gone(spark, before)
    assert spark.conf.get(KEY) == setting
    # the plan it came from can be run again, also with its shuffle freed
    with freed_shuffles(spark):
        assert df.count() == df.count() == 7
    assert df.exceptAll(table).isEmpty() and table.count() == 7


def test_setting_comes_back_after_a_failure(spark):
    before = spark.conf.get(KEY)
    try:
        with freed_shuffles(spark):
            assert spark.conf.get(KEY) == "true"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(KEY) == before


def test_short_lived_tables_are_removed(spark):
    with short_lived(_grouped(spark)) as table:
        files = [f.removeprefix("file://") for f in table.inputFiles()]
        assert files and all(map(os.path.exists, files)) and table.count() == 7
    assert not any(map(os.path.exists, files))


def _tables(spark) -> set[str]:
    return set(os.listdir(shared_folder(spark).removeprefix("file:")))


def test_steps_keep_only_what_is_read_later(spark):
    reads = spark.createDataFrame([(0, p, p + 30) for p in range(0, 900, 7)] * 2, "ctg long, pos long, epos long")
    frames = spark.createDataFrame([(0, 10, 99), (0, 50, 700)], "ctg long, begin long, end long")
    before = _tables(spark)
    rows = cv.frame_reads_length(frames, reads, ["ctg", "begin", "end"])
    assert len(_tables(spark) - before) == 1
    want = {(b, e): 2 * sum(max(0, min(e + 1, p + 30) - max(b, p)) for p in range(0, 900, 7)) for b, e in ((10, 99), (50, 700))}
    assert {(r.begin, r.end): r.reads_len for r in rows.collect()} == want
    before = _tables(spark)
    got = T.island_starts(reads.groupBy("ctg", "pos").agg(F.max("epos").alias("e")), ["ctg"], "pos", "e", "i", bits=3)
    assert len(_tables(spark) - before) == 1
    assert {r.i for r in got.collect()} == {0}


def test_expressions_are_summed_without_a_column_of_their_own(spark, tiled):
    df = spark.createDataFrame([(1, p, p % 5 - 2) for p in range(40)], "k long, p long, d long")
    run = T.exclusive_prefix(df, ["k"], "p", {"w": ("sum", F.col("d") * F.col("p"))})
    assert {r.p: r.w for r in run.collect()} == {p: sum((q % 5 - 2) * q for q in range(p)) for p in range(40)}


def test_last_master_alignment_wins_and_its_columns_travel_once(spark):
    schema = "name string, mate int, ctg long, pos long, epos long, rev boolean, lib_id int"
    master = spark.createDataFrame(
        [("a", 1, 2, 5, 9, False, 0), ("a", 1, 1, 8, 12, True, 1), ("a", 1, 2, 5, 9, True, 0), ("b", 1, None, 3, 7, False, 0), ("c", 2, 0, 1, 4, None, None)], schema
    )
    slave = spark.createDataFrame([("a", 1, 7, 1, 5, True, 0), ("b", 1, 7, 2, 6, False, 0), ("c", 2, 7, 3, 6, False, 0), ("c", 2, 8, 3, 6, False, 0)], schema)
    for order, first in ((("ctg", "pos", "lib_id"), (2, 5, 8, True)), (("lib_id",), (1, 8, 11, True))):
        pairs = R.read_pairs(master, slave, order)
        got = sorted((r.name, r.s_ctg, r.m_ctg, r.m_start, r.m_last, r.concordant) for r in pairs.collect())
        assert got == [("a", 7, *first), ("b", 7, None, 3, 6, True), ("c", 7, 0, 1, 3, None), ("c", 8, 0, 1, 3, None)]
        assert "max_by" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_only_the_result_of_some_steps_stays(spark):
    from contigloom.operators.blocks import blocks_by_islands

    pairs = spark.createDataFrame(
        [(1, 2, p, p + 9, p + 100, p + 109, True) for p in (0, 5, 40, 44)], "m_ctg long, s_ctg long, m_start long, m_last long, s_start long, s_last long, concordant boolean"
    )
    before = _tables(spark)
    blocks = blocks_by_islands(pairs)
    assert len(_tables(spark) - before) == 1
    assert sorted((r.num_reads, r.m_begin, r.s_end, r.s_strand) for r in blocks.collect()) == [(2, 0, 114, "+"), (2, 40, 153, "+")]
    assert blocks_by_islands(pairs, 3).isEmpty()
    before = _tables(spark)

    def inner():
        return result_only(lambda: cut_lineage(cut_lineage(_grouped(spark)).where("k > 1"))).where("k > 2")

    assert sorted(r.k for r in result_only(inner).collect()) == [3, 4, 5, 6]
    assert len(_tables(spark) - before) == 1


def test_blocks_free_the_join_of_their_pairs(spark, monkeypatch):
    from contigloom.operators import blocks as B

    sides = [
        spark.createDataFrame([(f"r{i}", 1, i % 2, 7 * i, 7 * i + 20, False, 0) for i in range(200)], "name string, mate int, ctg long, pos long, epos long, rev boolean, lib_id int")
        for _ in range(2)
    ]
    left = []
    first = B._starts

    def starts(placements, keys):
        left.append((_gone(spark, before), "JOIN" in placements._jdf.queryExecution().optimizedPlan().toString().upper()))
        return first(placements, keys)

    monkeypatch.setattr(B, "_starts", starts)
    for build in (B.blocks_by_islands, B.build_blocks):
        tables, before = _tables(spark), _shuffle_files(spark)
        blocks = build(R.read_pairs(*sides))
        paths = [f.removeprefix("file://") for f in blocks.inputFiles()]
        assert paths and all(map(os.path.exists, paths))
        assert sum(r.num_reads for r in blocks.collect()) == 200
        assert all("m_start" not in spark.read.parquet(f"{shared_folder(spark)}/{x}").columns for x in _tables(spark) - tables)
    assert left == [(True, False)] * len(left) and left
