import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from contigloom.llm import near_dedup, words
from contigloom.llm.near_dedup import near_duplicates


def brute_sets(rows, k):
    sets = []
    for text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append(frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return sets


def brute(rows, k=4):
    """{(id, set size, component, kept)} by comparing all pairs."""
    ids, sets = [i for i, _ in rows], brute_sets([t for _, t in rows], k)
    parent = {i: i for i in ids if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (ids[a], ids[b]) and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return sorted(
        ((i, len(s), None if i is None else root(i) if s else i, i is None or not s or root(i) == i) for i, s in zip(ids, sets)), key=str
    )


def got(spark, docs, **kw):
    return sorted(map(tuple, near_duplicates(docs, words=4, **kw).collect()), key=str)


def test_word_hashes_are_words():
    texts = ["Hello wOrld\tfoo", "", None, "foo", "ünï cödé foo", "a" * 5000, "hello", "world  hello\n"]
    known = {}
    for inside, pattern in ((words.SPACED, rb"[^\x20\x09-\x0D]+"), (words.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for lo, hi, offsets, hashes in words.hash_words(pa.array(texts), inside):
            for r in range(lo, hi):
                want = re.findall(pattern, (texts[r] or "").encode().lower())
                own = hashes[offsets[r - lo] : offsets[r - lo + 1]]
                assert len(want) == len(own)
                assert all(known.setdefault(w, h) == h for w, h in zip(want, own))
    assert len(set(known.values())) == len(known)


def test_slices_and_cuts_do_not_change_hashes(monkeypatch):
    texts = pa.array(["one two  three", None, "four five six seven eight nine ten", ""])
    whole = np.concatenate([h for *_, h in words.hash_words(texts, words.SPACED)])
    monkeypatch.setattr(words, "SLICE", 3)
    assert (np.concatenate([h for *_, h in words.hash_words(texts, words.SPACED)]) == whole).all()


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_equals_all_pairs(spark, monkeypatch, block):
    """Chains of near copies around the threshold, exact copies and a passage that many share; also with buckets cut in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "STAR", 3)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    rows = []
    for group in range(12):
        base = [word() for _ in range(r.randint(5, 120))]
        for _ in range(12):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 20))):
                text[r.randrange(len(text))] = word()
            if group % 3 == 0:
                text = passage + text
            rows.append((len(rows), " ".join(text)))
            if r.random() < 0.3:
                base = text  # copies of copies drift away from the first
    r.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(500, rows[0][1].upper()), (501, None), (502, "")]
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_base_many_unlinked_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(r.choice([1, 3, 4, 5])):
            text[r.randrange(100)] = f"x{r.random()}"
        rows.append((i, " ".join(text)))
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(spark, odd_docs) == brute(rows)


def test_empty(no_docs):
    assert near_duplicates(no_docs).collect() == []
