import math
import random

import numpy as np

from contigloom.llm import topk


def brute(rows, k):
    whole = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in whole:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def got(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cell", "'x' AS v")
    vectors = topk.whole_vectors(df)
    return sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k).collect()))


def test_equals_all_scores(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 40)
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + r.normal(size=12) / 5]) for i in range(900)]
    assert got(spark, rows) == brute(rows, 10)


def test_odd_rows(spark):
    random.seed(2)
    rows = [(i, [0.5, 0.25, -1.0]) for i in range(150)]  # ties: only smaller ids count
    rows += [(200, [0.5, None, 1.0]), (201, [float("nan"), 0.0, 0.0]), (202, None), (203, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(300, [1.0]), (301, []), (400, [0.0, 0.0, 0.0]), (400, [0.0, 0.0, 0.0])]
    assert got(spark, rows) == brute(rows, 10)


def test_few_and_none(spark):
    assert got(spark, [(0, [1.0])]) == []
    assert got(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 1024 * 2048)]
    assert got(spark, []) == []
