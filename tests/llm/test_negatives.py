import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigloom.llm import negatives
from contigloom.llm.negatives import Heap, hard_negatives, strassen, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, row string"


@pytest.mark.parametrize("n,k,m", [(1, 1, 1), (5, 3, 7), (17, 17, 17), (64, 64, 64), (100, 33, 70), (129, 65, 200), (0, 64, 3)])
def test_strassen_equals_plain_product(n, k, m):
    r = np.random.default_rng(n)
    a, b = r.integers(-(10**6), 10**6, (n, k)), r.integers(-(10**6), 10**6, (k, m))
    assert (strassen(a, b) == a @ b).all()


def test_strassen_is_exact_where_sums_between_wrap():
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**62), 2**62, (40, 40)), r.integers(-1, 2, (40, 40)) * np.eye(40, dtype=np.int64)
    assert (strassen(a, b) == a @ b).all()


def test_heaps_merge_in_any_order():
    r = np.random.default_rng(2)
    scores, ids = r.integers(0, 6, (7, 60)), r.permutation(60)
    allowed = r.random((7, 60)) < 0.7
    want = [sorted((-scores[i, j], ids[j]) for j in range(60) if allowed[i, j])[:5] for i in range(7)]
    for cut in (1, 13, 60):
        for order in (1, -1):
            heap = Heap(7, 5)
            for at in list(range(0, 60, cut))[::order]:
                heap.merge(np.arange(7), scores[:, at : at + cut], ids[at : at + cut], allowed[:, at : at + cut].copy())
            got = [[] for _ in range(7)]
            for owner, score, one in zip(*heap.rows()):
                got[owner].append((-score, one))
            assert got == want


def brute(rows, positives=5, negatives=3):
    rows = [(i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, label in rows if taking_part(i, v, label)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (i, label, v) in enumerate(rows):
        if i % 50:
            continue
        scored = sorted((-dot(v, w), j, its) for n, (j, its, w) in enumerate(rows) if n != at)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return Counter(out)


def taking_part(i, v, label):
    return i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)


def got(spark, rows):
    df = spark.createDataFrame([(i, v, label, "v", "r") for i, v, label in rows], SCHEMA)
    return Counter(tuple(x) for x in hard_negatives(whole_vectors(df), F.col("vec_id") % 50 == 0).collect())


def test_equals_brute_force_on_odd_rows(spark, monkeypatch):
    r = random.Random(4)
    vector = lambda n=6: [r.choice([0.0, 0.5, -0.25, 1.0, r.random()]) for _ in range(n)]
    rows = [(i, vector(), r.choice([0, 0, 0, 1, 2])) for i in range(300)]
    rows += [(i, rows[0][1], 1) for i in range(300, 340)]  # a common vector: ties by id
    rows += [(50, rows[50][1], rows[50][2])] * 9  # an anchor in many equal rows
    rows += [(51, vector(), 0), (51, vector(), 1), (100, vector(), 3)]  # other rows of an id, a label of its own
    rows += [(350, None, 1), (351, vector(), None), (None, vector(), 1), (400, [1.0, None], 1), (450, [float("nan")], 1), (500, [float("inf")], 2)]
    rows += [(550, [], 0), (600, [1.0, 2.0], 0), (-50, vector(), 1)]
    want = brute(rows)
    assert len(want) > 30 and got(spark, rows) == want
    monkeypatch.setattr(negatives, "BLOCK", 3)  # many blocks and splits
    monkeypatch.setattr(negatives, "SHARE", 20)
    assert got(spark, rows) == want


def test_small_tables(spark):
    assert not got(spark, [])
    assert not got(spark, [(0, [1.0], 0)])
    assert not got(spark, [(0, [1.0], 0), (1, [1.0], 0), (3, None, 1)])
    assert got(spark, [(0, [0.0], 0), (1, [1.0], 0), (2, [9.0], 1)]) == Counter([(0, 1, 1, 2, 0, 0)])  # a window of 0 to 0
    assert not got(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.75], 1)])  # a negative positive has no window
