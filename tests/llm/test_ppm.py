import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigloom.llm import ppm
from contigloom.llm.shared import crc_part


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b" "]


class Trie:
    """Plain PPM: every context with its symbols, exclusion by sets."""

    def __init__(self, order):
        self.order, self.seen = order, defaultdict(Counter)

    def contexts(self, text):
        data = b"\xff" * self.order + (text or "").encode().lower() + b"\xff"
        return [(data[i - self.order : i], data[i]) for i in range(self.order, len(data))]

    def learn(self, text):
        for context, symbol in self.contexts(text):
            for k in range(self.order + 1):
                self.seen[context[self.order - k :]][symbol] += 1

    def log10(self, context, symbol):
        total, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            own = {s: c for s, c in self.seen[context[self.order - k :]].items() if s not in excluded}
            if symbol in own:
                return total + math.log10(own[symbol] / (sum(own.values()) + len(own)))
            if own:
                total += math.log10(len(own) / (sum(own.values()) + len(own)))
            excluded |= set(own)
        return total - math.log10(256 - len(excluded))

    def score(self, text):
        return sum(self.log10(c, s) for c, s in self.contexts(text))


def check(rows, got, order):
    trie, counts = Trie(order), Counter()
    for i, t in rows:
        if not held(i):
            trie.learn(t)
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, held(i), len(w), sum(x in counts for x in w), n, base, trie.score(t)))
    key = lambda r: (str(r[0]), round(r[6], 3))
    got = sorted((tuple(r)[:7] for r in got), key=key)
    want.sort(key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want])


@pytest.mark.parametrize("order, block", [(2, 1 << 20), (5, 4000)])
def test_equals_plain_trie(spark, monkeypatch, order, block):
    monkeypatch.setattr(ppm, "BLOCK", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 3000).limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, ppm.ppm_scores(docs, crc_part(F.col("doc_id"), 7) == 2, order).collect(), order)


def test_default_is_order_five(spark):
    rows = [(i, t) for i, t in enumerate(["abracadabra abracadabra", "bananas and bread and bananas", "cabbage", "abracadabra bread"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, ppm.ppm_scores(docs, crc_part(F.col("doc_id"), 7) == 2).collect(), 5)


def test_counts_are_merged_as_they_come():
    r, parts, want = np.random.default_rng(1), [], Counter()
    for _ in range(200):
        codes, trained = r.integers(0, 500, 300).astype(np.uint64), r.integers(0, 2, 300).astype(float)
        ppm._add(parts, ppm._counted(codes, trained))
        for c, t in zip(codes.tolist(), trained.tolist()):
            want[c] += int(t)
        assert sum(len(k) for k, _ in parts) <= 2 * len(want)
    keys, counts = ppm._totals(parts)
    assert dict(zip(keys.tolist(), counts.tolist())) == want


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.where("text IS NULL OR length(text) < 5000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, ppm.ppm_scores(docs, crc_part(F.col("doc_id"), 7) == 2, 3).collect(), 3)
    assert ppm.ppm_scores(odd_docs, F.lit(False)).count() == odd_docs.count()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    row = ppm.ppm_scores(docs, F.lit(True)).first()
    assert (row.train_tokens, row.n_known) == (0, 0) and row.score == pytest.approx(-3 * math.log10(256))


def test_empty(no_docs):
    assert ppm.ppm_scores(no_docs, F.lit(False)).collect() == []


def test_probabilities_of_all_symbols_add_up():
    trie = Trie(3)
    for t in ("abracadabra", "bananas and bread", "cabbage"):
        trie.learn(t)
    for context in (b"abr", b"zzz", b"\xff\xff\xff", b"and"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        grams = {k for c, s in ((c, s) for t in ("abracadabra", "bananas and bread", "cabbage") for c, s in trie.contexts(t)) for k in [int.from_bytes(c + bytes([s]), "big")]}
        every = np.unique(np.concatenate([keys, np.array(sorted(grams), np.uint64)]))
        counts = np.array([trie.seen[int(k).to_bytes(4, "big")[:3]][int(k) & 255] for k in every], float)
        pairs = np.array([[trie.seen[bytes([c])][s] for s in range(256)] for c in range(256)])
        logs = ppm.gram_log10(every, counts, pairs, 3)
        assert (10 ** logs[np.searchsorted(every, keys)]).sum() == pytest.approx(1)


def test_adaptive_learns_as_it_reads(spark):
    docs = spark.createDataFrame([(1, "ab" * 200), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm.adaptive_scores(docs).collect()}
    assert got[2] == got[3] == pytest.approx(-math.log10(256)) and got[1] > -400 * math.log10(256) / 8
