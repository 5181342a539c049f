import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from contigloom.llm import divergence
from contigloom.llm.divergence import audit, gallop, merged_price

DOCS = "doc_id long, text string, lang string, source string, term string, kept long, item string"


def brute(rows):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[(lang or "", source or "")].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for (lang, source), own in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        whole = Counter()
        for (other, _), its in groups.items():
            if other == lang:
                whole.update(its)

        def shares(counts):
            by = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // by for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = shares(own), shares(whole)
        pairs = [(s, sum(f(p[t], x) for t, x in shares(its).items())) for (other, s), its in groups.items() if other == lang and s != source]
        terms = [(t, f(p[t], q[t])) for t in kept if own[t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return Counter(out)


def got(spark, rows):
    df = spark.createDataFrame([(1, *r, "t", 3, "i") for r in rows], DOCS)
    return Counter(tuple(r) for r in audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def invented(seed, n=400):
    r = random.Random(seed)
    words = [w + x for w in ["alpha", "Beta", "été", "Öl", "x", "don't", "a1b", "ΣΑ"] for x in ["", "s", "Er"]]
    rows = []
    for i in range(n):
        source = r.choice(["s0", "s0", "s0", "s1", "s2", "é", None])
        part = words[r.randrange(6) :: 2] if source == "s1" else words
        rows.append((" ".join(r.choice(part) for _ in range(r.randint(0, 30))), r.choice(["en", "en", "fr", None]), source))
    return rows


def test_equals_brute_force_on_odd_rows(spark, monkeypatch):
    rows = invented(3)
    rows += [(None, "en", "silent"), ("", "en", "empty"), ("1 2 3", "de", "digits"), (None, None, None), (rows[0])] + [rows[1]] * 20
    rows += [("alpha " * 50_000 + "x" * 100_000, "en", "long"), ("rare words only", "es", "a"), ("other rare ones", "es", "b")]
    want = brute(rows)
    assert {x[2] for x in want} == {"pair", "term"} and any(x[0] == "es" and x[4] == 0 for x in want)
    assert got(spark, rows) == want
    monkeypatch.setattr(divergence, "SLICE_BITS", 2)  # many slices and bundles
    monkeypatch.setattr(divergence, "BUNDLE", 2)
    assert got(spark, rows) == want


def test_empty_table(spark):
    assert not got(spark, [])


def test_counted_passes_on_what_it_holds(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"a b c d", b"a A", b"", b"b \xc3\xa9"]), pa.array(["l"] * 4), pa.array(["s"] * 4)], ["text", "lang", "source"]
    )
    n, docs, sizes = Counter(), Counter(), []
    for part in divergence._counted([batch, batch]):
        sizes.append(part.num_rows)
        for row in part.to_pylist():
            n[row["term"]] += row["n"]
            docs[row["term"]] += row["docs"]
    assert n == {b"a": 6, b"b": 4, b"c": 2, b"d": 2, b"\xc3\xa9": 2} and docs[b"a"] == 4 and len(sizes) > 1


@pytest.mark.parametrize("n,m", [(0, 5), (3, 0), (1, 1000), (200, 200), (70, 10_000), (500, 30)])
def test_gallop_and_merge(n, m):
    r = np.random.default_rng(n + m)
    ids, other = (np.sort(r.choice(12_000, k, replace=False)) for k in (n, m))
    if n:
        assert (gallop(ids, other) == np.searchsorted(other, ids)).all()
    p, q = r.integers(1, 10**9, n), r.integers(1, 10**9, m)
    left, right = dict(zip(ids.tolist(), p.tolist())), dict(zip(other.tolist(), q.tolist()))
    want = sum((left.get(i, 7) - right.get(i, 900)) ** 2 // (left.get(i, 7) + right.get(i, 900)) for i in range(12_000))
    a, b = (ids, p, np.array([7])), (other, q, np.array([900]))
    assert merged_price(a, b, 12_000) == merged_price(b, a, 12_000) == want


def test_shares_do_not_overflow():
    n = np.array([0, 5, 3 * 10**15])
    total, kept = 4 * 10**15, 10**7
    assert divergence._shares(n, total, kept).tolist() == [1 + 10**9 * (x + 2) // (total + 2 * kept) for x in n.tolist()]
