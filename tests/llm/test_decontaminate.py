import itertools
import random
import re

import numpy as np

from contigloom.llm.decontaminate import MASKS, SPAN, _best_stretch, overlaps, without_overlaps


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute(docs, items, min_words=8, min_share=0.75):
    """All stretches on all diagonals, whatever the masks: the one with the most equal words beyond the share, the leftmost of equals."""
    seen, out = {}, set()
    for i, t in items:
        w = tuple(words(t))
        if i is not None and len(w) >= 3:
            seen[w] = min(i, seen.get(w, i))
    for doc, text in docs:
        d = words(text)
        for w, item in seen.items():
            for diagonal in range(-len(w) + 1, len(d)):
                inside = range(max(0, -diagonal), min(len(w), len(d) - diagonal))
                n = list(itertools.accumulate((d[diagonal + j] == w[j] for j in inside), initial=0))
                if n[-1] < min(min_words, len(w)):
                    continue
                stretches = [
                    (min_share * (b - a) - (n[b] - n[a]), b, a)
                    for b in range(len(n))
                    for a in range(b)
                    if n[b] - n[a] >= min(min_words, len(w))
                ]
                missing, b, a = min(stretches)
                if missing <= 0:
                    out.add((doc, item, diagonal + inside[0] + a, b - a, n[b] - n[a]))
    return out


def got(docs, items):
    return {(r.doc_id, r.item_id, r.doc_word, r.n_words, r.n_equal) for r in overlaps(docs, items).collect()}


def test_equals_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([14, 30, 60, 11, 10, 5, 3, 2, 40, 12])] + [(99, None), (98, ""), (None, "a b c d e f g h i j k l")]
    items.append((50, items[1][1].upper()))  # equal to item 1
    docs = []
    for i in range(60):
        text = [word() for _ in range(r.randint(0, 60))]
        part = items[r.randrange(10)][1].split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            part[r.randrange(len(part))] = word()
        part = part[r.choice([0, 0, 3]) :]
        at = r.randint(0, len(text))
        docs.append((i, " ".join(text[:at] + part + text[at:]) if i % 3 else " ".join(text)))
    docs += [(100, items[2][1] + " . " + items[2][1]), (101, None), (102, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(x[0], x[1]) for x in want} and got(d, b) == want
    left = {r.doc_id for r in without_overlaps(d, overlaps(d, b)).collect()}
    assert left == {i for i, _ in docs} - {x[0] for x in want}


def test_odd_rows(spark, odd_docs, no_docs):
    text = odd_docs.where("doc_id = 7").first().text.split()[100:140]
    items = spark.createDataFrame([(1, " ".join(text), 3), (1, " ".join(text), 3), (2, "another text of one id", 4)], "item_id long, text string, seed int")
    rows = sorted((r.doc_id, r.item_id) for r in overlaps(odd_docs, items).collect())
    assert rows == [(7, 1), (8, 1), (9, 2), (9, 2)]
    assert without_overlaps(odd_docs, overlaps(odd_docs, items)).count() == odd_docs.count() - 4
    assert overlaps(no_docs, items).collect() == [] and overlaps(odd_docs, items.limit(0)).collect() == []
    assert without_overlaps(odd_docs, overlaps(odd_docs, items.limit(0))).count() == odd_docs.count()


def changed(text, *places):
    return " ".join(f"other{i}" if i in places else w for i, w in enumerate(text.split()))


def test_no_overlap_is_hidden_by_the_masks(spark):
    item = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    items = [(i, item(i, n)) for i, n in enumerate([30, 30, 11, 11, 12, 10, 10, 8, 9])]
    part = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    docs = [part(0, 5, 13), part(1, 20, 30), changed(items[2][1], 0), changed(items[3][1], 10), changed(items[4][1], 1, 10), changed(items[5][1], 4), changed(items[6][1], 1)]
    docs += [items[7][1], changed(items[8][1], 5)]
    docs = [(i, f"before it {t} after it") for i, t in enumerate(docs)] + [(20, part(0, 5, 12)), (21, changed(items[8][1], 3, 6)), (22, changed(items[7][1], 3))]
    found = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(9)]


def test_masks_fit_every_smallest_overlap():
    accepted = lambda p: sum(p) >= 8 and sum(p) >= 0.75 * len(p)
    n = 0
    for words in range(8, 17):
        for other in range(words // 3 + 1):
            for at in itertools.combinations(range(1, words + other - 1), other):
                p = [i not in at for i in range(words + other)]
                if accepted(p[1:]) or accepted(p[:-1]) or any(accepted(p[a:b]) for a in range(len(p)) for b in range(a + 8, len(p) + 1) if b - a < len(p)):
                    continue
                n += 1
                assert any(all(c == "0" or p[k + j] for j, c in enumerate(m)) for m in MASKS for k in range(len(p) - len(m) + 1)), p
    assert n == 133


def test_no_stretch_hides_another(spark):
    long = " ".join(f"w{j}" for j in range(220))
    more = changed(long, *(j for j in range(20, 220) if j % 10 > 6))
    ten = " ".join(f"v{j}" for j in range(10))
    apart = " ".join(f"u{j}" for j in range(60))
    docs = [(1, f"x y {more} z"), (2, f"x {changed(ten, 3, 7)} z"), (3, changed(apart, *range(7, 40), 43, 46, *range(51, 60)))]
    items = spark.createDataFrame([(1, long), (2, ten), (3, apart)], "item_id long, text string")
    found = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 2), (3, 3)}
    assert all(r.n_equal >= 8 and r.n_equal >= 0.75 * r.n_words for r in found)


def test_stretch_is_found_where_there_is_one():
    r = random.Random(5)
    for _ in range(1500):
        equal = [r.random() < r.choice([0.5, 0.75, 0.9]) for _ in range(r.randint(1, 40))]
        every = [(a, b) for a in range(len(equal)) for b in range(a + 8, len(equal) + 1) if sum(equal[a:b]) >= max(8, 0.75 * (b - a))]
        got = _best_stretch(np.array(equal), 8, 0.75)
        assert (got in every) if every else got is None
        if every:
            gain = lambda s: sum(equal[slice(*s)]) - 0.75 * (s[1] - s[0])
            assert gain(got) == max(map(gain, every))
