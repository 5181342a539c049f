import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigloom.llm import sharding


def plain_jump(key: int, shards: int) -> int:
    """The published loop, one key at a time."""
    key, at, to = key % 2**64, -1, 0
    while to < shards:
        at = to
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_equals_the_published_loop():
    keys = np.array([0, 1, 2, 3, 10**6, 2**63, 2**64 - 1, *range(1000, 1300)], dtype=np.uint64)
    for n in (1, 2, 7, 24, 25, 1000):
        assert sharding.jump(keys, n)[0].tolist() == [plain_jump(int(k), n) for k in keys]


def test_a_shard_more_takes_its_part_into_itself_alone():
    keys = np.arange(40_000, dtype=np.uint64)
    for n in (1, 3, 24):
        before, after = sharding.jump(keys, n, n + 1)
        gone = before != after
        assert (after[gone] == n).all()
        assert abs(gone.mean() - 1 / (n + 1)) < 0.01
        assert np.bincount(after, minlength=n + 1).max() < 1.1 * len(keys) / (n + 1)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_digest_of_odd_documents(spark, odd_docs):
    rows = rows_of(sharding.digest(odd_docs, 24))
    want = Counter()
    for d in odd_docs.collect():
        raw = (d.text or "").encode()
        want[(d.doc_id, len(raw) + 8, zlib.crc32(raw), plain_jump(d.doc_id or 0, 24), plain_jump(d.doc_id or 0, 25))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == want
    assert {r["law"] for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]))
    for own in slots.values():
        assert [s for s, _ in sorted(own)] == list(range(len(own)))
        assert [i for _, i in sorted(own)] == sorted(i for _, i in own)


def test_empty_table(spark, no_docs):
    assert sharding.digest(no_docs, 24).collect() == []


def test_a_hot_key_is_split_and_its_slots_are_gapless(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    dealt = sharding.with_slots(sharding.assign(hot, "doc_id", 4), ["doc_id"])
    n = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert sum(r.n for r in n) == 30_000
    assert all(r.n == r.d == r.hi + 1 and r.lo == 0 for r in n)


def test_other_kinds_of_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4), (None, 5, 6), ("a", 7, 8)], "url string, shard int, slot int")
    rows = rows_of(sharding.with_slots(sharding.assign(df, "url", 3), ["url"]))
    assert len(rows) == 4 and all(set(r) == {"url", "shard", "grown_shard", "slot"} for r in rows)
    assert len({r["shard"] for r in rows if r["url"] == "a"}) == 1
    assert [r["shard"] for r in rows if r["url"] is None] == [plain_jump(0, 3)]
    with pytest.raises(ValueError):
        sharding.assign(df, "url", 0)


def test_written_shards_and_moves(spark, odd_docs, tmp_path):
    path = str(tmp_path / "out")
    sizes = {r["shard"]: r["rows"] for r in sharding.write(odd_docs, "doc_id", 5, path).collect()}
    back = spark.read.parquet(path)
    assert sum(sizes.values()) == odd_docs.count() == back.count()
    assert set(back.columns) == {*odd_docs.columns, "shard"}
    assert all(plain_jump(r["doc_id"] or 0, 5) == r["shard"] for r in back.collect())
    gone = sharding.moved(odd_docs, "doc_id", 2, 6).collect()
    assert all(r["from_shard"] < 2 <= r["to_shard"] < 6 for r in gone)
    assert len(gone) == sum(plain_jump(d.doc_id or 0, 2) != plain_jump(d.doc_id or 0, 6) for d in odd_docs.collect())
