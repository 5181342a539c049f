from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contigloom.llm import mixing


def fill(children, budget):
    """Water level by rounds: children (name, weight, capacity) share by weight, full ones give back."""
    given, left, active = {}, budget, dict((n, (w, c)) for n, w, c in children if w)
    while active:
        weight = sum(w for w, _ in active.values())
        full = {n: c for n, (w, c) in active.items() if c * weight <= left * w}
        if not full:
            return given | {n: min(left * w // weight, c) for n, (w, c) in active.items()}
        given |= full
        left -= sum(full.values())
        active = {n: x for n, x in active.items() if n not in full}
    return given


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)], ", ".join(f"{c} string" for c in mixing.LEVELS) + ", tokens long"
    )
    got = {r.mix_source: r.budget for r in mixing.budgets(leaves, {"lang": {"en": 2}}, 600, 1).collect()}
    # 300 a domain; en gets 200 of a's, s1 can only give 10 and s2 takes up the rest; de is not touched
    assert got == {"s1": 10, "s2": 190, "s3": 100, "s4": 300}
    got = {r.mix_source: r.budget for r in mixing.budgets(leaves, {}, 5000, 1).collect()}
    assert got == {"s1": 10, "s2": 1000, "s3": 1000, "s4": 1000}
    got = {r.mix_source: r.budget for r in mixing.budgets(leaves, {"source": {"s2": 0}}, 600, 1).collect()}
    assert got == {"s1": 10, "s2": 0, "s3": 290, "s4": 300}


def test_budgets_equal_rounds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    weights = {"domain": {"domain0": 5, "domain1": 1}, "lang": {"en": 3}}
    leaves = mixing._nodes(docs).groupBy(*mixing.LEVELS).agg(F.sum("mix_tokens").alias("tokens"))
    rows = [tuple(r) for r in leaves.collect()]
    total = 20_000
    weight = lambda level, name: weights.get(level, {}).get(name, 1)
    cap = defaultdict(int)
    for d, lang, s, t in rows:
        for k in ((d,), (d, lang), (d, lang, s)):
            cap[k] += 2 * t
    want = {}
    for d, b in fill([(k[0], weight("domain", k[0]), c) for k, c in cap.items() if len(k) == 1], total).items():
        for lang, bl in fill([(k[1], weight("lang", k[1]), c) for k, c in cap.items() if len(k) == 2 and k[0] == d], b).items():
            for s, bs in fill([(k[2], weight("source", k[2]), c) for k, c in cap.items() if len(k) == 3 and k[:2] == (d, lang)], bl).items():
                want[d, lang, s] = bs
    got = {tuple(r)[:3]: r.budget for r in mixing.budgets(leaves, weights, total, 2).collect()}
    assert got == want


def test_each_leaf_gets_its_budget_exactly(spark, odd_docs):
    docs = odd_docs.drop("mix_tokens").unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("*", F.lit("c").alias("cls"), F.lit(7).alias("key"), F.lit("w").alias("words"))
    )
    leaves = mixing._nodes(docs).groupBy(*mixing.LEVELS).agg(F.sum("mix_tokens").alias("tokens"))
    budget = {tuple(r)[:3]: r.budget for r in mixing.budgets(leaves, {}, 150_000, 3).collect() if r.budget}
    rows = mixing.mix(docs, {}, 150_000, 3, seed=4).collect()
    taken = defaultdict(int)
    for r in rows:
        taken[r.mix_domain, r.mix_lang, r.mix_source] += r.mix_epochs * r.mix_tokens + r.mix_extra
        assert 0 <= r.mix_extra <= r.mix_tokens
    assert taken == budget
    cut = defaultdict(int)
    for r in rows:
        cut[r.mix_domain, r.mix_lang, r.mix_source] += 0 < r.mix_extra < r.mix_tokens
    assert max(cut.values()) <= 1


def test_many_leaves_take_the_other_join(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {(r.doc_id, r.mix_epochs, r.mix_extra) for r in mixing.mix(docs, {}, 0.6, 2).collect()}
    monkeypatch.setattr(mixing, "MOST_LEAVES", 0)
    assert one == {(r.doc_id, r.mix_epochs, r.mix_extra) for r in mixing.mix(docs, {}, 0.6, 2).collect()}


def test_seed_changes_the_order_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two, again = ({(r.doc_id, r.mix_extra) for r in mixing.mix(docs, {}, 0.3, 1, seed=s).collect()} for s in (1, 2, 1))
    assert one == again != two


@pytest.mark.parametrize("total", [0, 0.0, 0.5])
def test_empty(no_docs, total):
    assert mixing.mix(no_docs, {}, total).collect() == []


def test_odd_rows_keep_their_columns(odd_docs):
    got = mixing.mix(odd_docs, {}, 1.0, 1)
    assert got.columns[:8] == [c for c in odd_docs.columns if c != "mix_tokens"]
    assert got.count() == odd_docs.where(r"text rlike '[^\\x20\\x09-\\x0D]'").count()
