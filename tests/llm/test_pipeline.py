import corpus_pipeline as cp
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from contigloom.llm import queries
from contigloom.llm.shared import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, name):
    ok, message = compare(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name])
    assert ok, message


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mail = docs.where("text like '%@mail%'").count()
    counts = {}
    for name, stage in cp.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), "t")
        counts[name] = before.count(), docs.count()
        if name != "mix":
            assert docs.columns == before.columns
    assert mail and docs.where("text like '%@mail%'").count() == 0
    assert counts["quality"][1] < counts["quality"][0] and counts["near_duplicates"][1] < counts["near_duplicates"][0]
    assert counts["personal_data"][0] == counts["personal_data"][1]


def test_each_stage_by_brute_force(spark):
    """What each stage keeps, from its own input, by the plain versions of the operators' tests."""
    from test_decontaminate import brute as leaks
    from test_near_dedup import brute as groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(r.doc_id for r in cp.keep_one_of_near_copies(spark, docs, SF).collect())
    assert got == sorted(i for i, _, _, kept in groups(rows, 5) if kept)
    short = docs.where(F.length("text") < 2500).limit(60)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {x[0] for x in leaks([(r.doc_id, r.text) for r in short.collect()], items)}
    assert {r.doc_id for r in cp.drop_benchmark(spark, short, SF).collect()} == {r.doc_id for r in short.collect()} - bad


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in cp.STAGES:
            docs = stored(stage(spark, docs, SF), "t")
        assert (docs.count() == 0) == (start is no_docs)
    assert cp.keep_one_of_near_copies(spark, odd_docs, SF).where("doc_id = 5").count() == 1
    assert cp.redact(spark, odd_docs, SF).count() == odd_docs.count()


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {f"op{i}_" for i in range(1, 11)} == {n[: n.index("_") + 1] for n in names if n.startswith("op")}
    assert set(e.oracle_sql()) <= names
