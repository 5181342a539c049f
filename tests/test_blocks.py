import random

from contigloom.operators import blocks as B
from contigloom.operators import coverage, tiled

SCHEMA = "m_ctg long, s_ctg long, m_start long, m_last long, s_start long, s_last long, name string, mate int, concordant boolean"


def _pairs(spark, rows):
    return spark.createDataFrame([(0, 0, m0, m1 - 1, s0, s1 - 1, str(i), 1, c) for i, (m0, m1, s0, s1, c) in enumerate(rows)], SCHEMA)


def _greedy(rows):
    """First open block that touches on both axes, pairs in slave order."""
    blocks = []
    for s0, s1, m0, m1, c in sorted(((s0, s1 - 1, m0, m1 - 1, not c) for m0, m1, s0, s1, c in rows)):
        vote = -1 if c else 1
        for b in blocks:
            if b[2] + 1 >= m0 and m1 + 1 >= b[1] and b[4] + 1 >= s0 and s1 + 1 >= b[3]:
                b[0] += 1
                b[1], b[2], b[3], b[4], b[5] = min(b[1], m0), max(b[2], m1), min(b[3], s0), max(b[4], s1), b[5] + vote
                break
        else:
            blocks.append([1, m0, m1, s0, s1, 0])
    return sorted((b[0], b[1], b[2], b[3], b[4], "+" if b[5] >= 0 else "-") for b in blocks)


def _got(df):
    return sorted((r.num_reads, r.m_begin, r.m_end, r.s_begin, r.s_end, r.s_strand) for r in df.collect())


def test_non_collinear_pairs(spark):
    rows = [(0, 10, 0, 10, True), (5, 15, 5, 15, True), (100, 110, 8, 18, True), (12, 20, 16, 24, True)]
    got = _got(B.build_blocks(_pairs(spark, rows), 2))
    assert got == [(2, 0, 14, 0, 14, "+")]
    assert [r[0] for r in _got(B.blocks_by_islands(_pairs(spark, rows)))] == [4]


def test_adjacent_pairs_touch(spark):
    base = (0, 10, 0, 10, True)
    assert len(_got(B.build_blocks(_pairs(spark, [base, (10, 20, 10, 20, True)])))) == 1
    assert len(_got(B.build_blocks(_pairs(spark, [base, (11, 21, 11, 21, True)])))) == 2


def test_seed_does_not_vote(spark):
    rows = [(0, 10, 0, 10, False), (2, 12, 2, 12, True), (4, 14, 4, 14, False)]
    assert _got(B.build_blocks(_pairs(spark, rows)))[0][5] == "+"


def test_random_pairs_equal_brute_force(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = []
        for _ in range(250):
            s, m = rnd.randint(0, 300), rnd.choice([0, 150, 400]) + rnd.randint(0, 60)
            rows.append((m, m + rnd.randint(3, 9), s, s + rnd.randint(3, 9), rnd.random() < 0.5))
        rows += rows[:20]  # copies of a placement
        assert _got(B.build_blocks(_pairs(spark, rows))) == _greedy(rows)


def test_collinear_islands_equal_greedy_in_tiles(spark, tiled):
    rnd = random.Random(5)
    rows = []
    for _ in range(200):
        s = rnd.randint(0, 2000)
        n = rnd.randint(5, 12)
        rows.append((s + 1000, s + 1000 + n, s, s + n, True))
    assert _got(B.blocks_by_islands(_pairs(spark, rows))) == _got(B.build_blocks(_pairs(spark, rows))) == _greedy(rows)


def test_islands_keep_no_placements(spark, monkeypatch):
    """Starts are labelled, not placements; of equal placements a concordant one is the seed."""
    rnd = random.Random(11)
    rows = []
    for at in range(0, 4000, 130):
        for _ in range(rnd.randrange(1, 5)):
            s0 = at + rnd.randrange(3)
            rows += [(s0, s0 + rnd.randrange(40, 43), s0, s0 + rnd.randrange(40, 43), rnd.random() < 0.5)] * rnd.randrange(1, 3)
            rows.append((*rows[-1][:4], not rows[-1][4]))
    stored = []
    for module in (B, tiled):
        monkeypatch.setattr(module, "cut_lineage", lambda df, keep=module.cut_lineage: stored.append(df.columns) or keep(df))
    assert _got(B.blocks_by_islands(_pairs(spark, rows))) == _greedy(rows)
    assert _got(B.build_blocks(_pairs(spark, rows))) == _greedy(rows)
    assert stored and not any("m_start" in columns for columns in stored)


def test_frame_borders_are_counted_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(coverage, "cut_lineage", lambda df, keep=coverage.cut_lineage: stored.append(df.columns) or keep(df), raising=False)
    reads = spark.createDataFrame([(0, p, p + 10) for p in range(0, 100, 4)] + [(0, 8, 18)], "ctg long, pos long, epos long")
    frames = spark.createDataFrame([(0, 5, 20), (0, 8, 17), (0, 0, 200)], "ctg long, begin long, end long")
    got = {(r.begin, r.end): r.reads_len for r in coverage.frame_reads_length(frames, reads, ["ctg", "begin", "end"]).collect()}
    spans = [(p, p + 10) for p in range(0, 100, 4)] + [(8, 18)]
    assert got == {(b, e): sum(max(min(e + 1, y) - max(b, x), 0) for x, y in spans) for b, e in ((5, 20), (8, 17), (0, 200))}
    assert stored == [["ctg", "at", "bases"]]
