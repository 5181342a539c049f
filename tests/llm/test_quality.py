from pyspark.sql import functions as F

from contigloom.llm import quality
from contigloom.llm.shared import crc_part

def train():
    return crc_part(F.col("doc_id"), 5) != 0


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.scores(docs.join(labels.where(~train()), "doc_id"), quality.fit(docs, labels, train())).collect()
    right = [(r.quality, r._score >= 0.3) for r in scored]
    good = [p for q, p in right if q == 1]
    bad = [not p for q, p in right if q == 0]
    assert len(right) > 700 and sum(good) >= 0.99 * len(good) and sum(bad) >= 0.9 * len(bad)
    assert all(0 <= r._score <= 1 for r in scored)


def test_only_the_text_counts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, train())
    other = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    one = {r.doc_id + 10**6: r._score for r in quality.scores(docs, model, ["doc_id"]).collect()}
    assert one == {r.doc_id: r._score for r in quality.scores(other, model, ["doc_id"]).collect()}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (7, None, 0), (4, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, labels, F.lit(True))
    scored = quality.scores(odd_docs.withColumn("_score", F.lit("own")), model)
    assert scored.columns == [*odd_docs.columns, "_score"]
    rows = scored.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r._score <= 1 for r in rows)
    assert len({r._score for r in rows if not r.text}) == 1  # null and empty alike
    assert sorted(map(str, (r.text for r in rows))) == sorted(map(str, (r.text for r in odd_docs.collect())))
    assert quality.scores(no_docs, model).collect() == []


def test_without_labels_of_both_classes(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {round(r._score, 6) for r in quality.scores(odd_docs, quality.fit(odd_docs, labels, F.lit(True))).collect()} == {1.0}
    assert {r._score for r in quality.scores(odd_docs, quality.fit(odd_docs, labels.limit(0), F.lit(True))).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.scores(no_docs, quality.fit(no_docs, both, F.lit(True))).collect() == []
