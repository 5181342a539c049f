import re

import pyarrow as pa

from contigloom.llm import near_dedup
from contigloom.llm import words as W


def hashes(text, kind=W.SPACED):
    return [int(h) for _, _, _, found in W.hash_words(pa.array([text]), kind) for h in found]


def test_long_words_are_told_apart_block_by_block():
    a, b, c = ("a" * 4096, "b" * 4096, "c" * 4096)
    long = [a + b, b + a, a + b + c, c + b + a, a + c + b, b + a + c, a * 3, a + a + b, b + a + a, "a" * 8191, "a" * 8192, "a" * 8193]
    assert len({hashes(w)[0] for w in long}) == len(long)
    assert hashes(a + b + " x " + a + b)[0] == hashes(a + b)[0]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    text = "one two ONE " + "y" * 10_000 + " three one " + "y" * 10_000
    got = hashes(text)
    names = re.split(" ", text.lower())
    assert len(got) == len(names)
    assert len(set(got)) == len(set(names)) and len({(n, h) for n, h in zip(names, got)}) == len(set(names))


def test_texts_of_swapped_blocks_are_no_near_duplicates(spark):
    a, b = "a" * 4096, "b" * 4096
    rows = [(1, f"{a}{b} x y z"), (2, f"{b}{a} x y z"), (3, f"{a}{b} x y z")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, similarity=80)
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 1}
