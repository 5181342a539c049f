import random

from pyspark.sql import functions as F

from contigloom.operators import assembly_graph as ag
from contigloom.operators import block_filters as bf
from contigloom.operators import components as C
from contigloom.operators import forks as fk
from contigloom.operators import strands as st


def _edges(spark, pairs):
    return spark.createDataFrame([(0, a, b) for a, b in pairs], "comp long, src long, dst long")


def test_components_equal_union_find(spark, monkeypatch):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 640)]
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {v: root(v) for v in parent}
    df = spark.createDataFrame(pairs, "u long, v long")
    assert {r.vertex: r.component for r in C.connected_components(df).collect()} == want

    def as_is(batches):  # no local merging: the stars do it all
        import pandas as pd

        for pdf in batches:
            both = pd.concat([pdf, pd.DataFrame({"u": pdf.u, "v": pdf.u}), pd.DataFrame({"u": pdf.v, "v": pdf.v})])
            yield both[["u", "v"]]

    monkeypatch.setattr(C, "_local_forest", as_is)
    assert {r.vertex: r.component for r in C.connected_components(df).collect()} == want


def test_chain_ranks_and_cycles(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    rows = [(order[0], None)] + [(b, a) for a, b in zip(order, order[1:])] + [(1000, 1001), (1001, 1000), (1002, 1001)]
    got = {r.node: (r.head, r.rank) for r in C.rank_chains(spark.createDataFrame(rows, "node long, prev long")).collect()}
    assert got == {v: (order[0], i) for i, v in enumerate(order)}


def _stored(spark, monkeypatch):
    """Partitions as they are (not packed into one), and a list that grows with every stored table of ``components``."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    calls, store = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: calls.append(1) or store(df))
    return calls


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """What follows the numbers is settled inside ranges, so rounds do not grow with the length."""
    try:
        calls = _stored(spark, monkeypatch)
        pairs = [(i, i + 1) for i in range(6000)] + [(9000 + i, 9001 + i) for i in range(0, 600, 3)]
        got = {r.vertex: r.component for r in C.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
        assert got == {v: 0 if v < 9000 else v - v % 3 for p in pairs for v in p}
        assert len(calls) <= 12
        calls.clear()
        nodes = spark.createDataFrame([(0, None)] + [(i + 1, i) for i in range(6000)], "node long, prev long")
        assert {r.node: (r.head, r.rank) for r in C.rank_chains(nodes).collect()} == {i: (0, i) for i in range(6001)}
        assert len(calls) <= 6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tour_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Masters 0, 2, 4, ... and slaves with far larger numbers in turn: the places follow the masters."""
    from contigloom.operators import spanning as sp

    n = 1500
    rows = [(0, 2 * i, 2 * (j + 5000) + 1) for i in range(n) for j in (i, i + 1)]
    try:
        calls = _stored(spark, monkeypatch)
        edges = spark.createDataFrame(rows, "component long, a long, b long")
        tour = sp.euler_tour(edges, spark.createDataFrame([(0, 0)], "component long, u long")).collect()
        assert len(calls) <= 10
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_rank = {r.rank: r for r in tour}
    assert sorted(by_rank) == list(range(4 * n)) and by_rank[0].u == 0
    assert all(by_rank[i].v == by_rank[i + 1].u for i in range(4 * n - 1))
    assert all(by_rank[r.back].back == r.rank and (by_rank[r.back].u, by_rank[r.back].v) == (r.v, r.u) for r in tour)


def test_tour_is_not_collected_by_the_driver(spark):
    """Tables as long as the graph meet by shuffles, however small each is."""
    from contigloom.operators import spanning as sp

    edges = spark.createDataFrame([(0, 0, 1), (0, 2, 1), (0, 2, 3)], "component long, a long, b long")
    tour = sp.euler_tour(edges, spark.createDataFrame([(0, 0)], "component long, u long"))
    plan = tour._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_random_and_ringed_lists_when_partitions_stay_apart(spark, monkeypatch):
    """Nothing shrinks where neighbours lie apart: the doubling and the stars give the same."""
    order = list(range(3000))
    random.Random(5).shuffle(order)
    rows = [(order[0], None)] + [(b, a) for a, b in zip(order, order[1:])] + [(5000, 9000), (9000, 5000), (7000, 9000), (8000, 8888)]
    try:
        _stored(spark, monkeypatch)
        got = {r.node: (r.head, r.rank) for r in C.rank_chains(spark.createDataFrame(rows, "node long, prev long")).collect()}
        assert got == {v: (order[0], i) for i, v in enumerate(order)}
        pairs = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
        assert {(r.vertex, r.component) for r in C.connected_components(pairs).collect()} == {(v, 0) for v in order}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _classes(spark, pairs):
    vertices = spark.createDataFrame([(v, 0) for v in sorted({x for p in pairs for x in p})], "vertex long, component long")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    return ag.graph_classes(vertices, edges).first().graph_class


def test_graph_classes(spark):
    assert _classes(spark, [(1, 2), (2, 3)]) == "linear"
    assert _classes(spark, [(1, 2), (1, 3), (2, 4), (3, 4)]) == "bubbles"
    assert _classes(spark, [(1, 2), (1, 3)]) == "forks"
    assert _classes(spark, [(1, 2), (2, 3), (3, 1)]) == "cyclic"
    assert _classes(spark, [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4)]) == "cyclic"
    # two sources into two sinks: forks on both ends, no pair of paths meets again
    assert _classes(spark, [(1, 3), (1, 4), (2, 4), (2, 3)]) == "forks"
    # branches that only meet after other forks
    assert _classes(spark, [(1, 2), (1, 3), (2, 5), (3, 5), (2, 6), (3, 7), (8, 6), (8, 7)]) == "bubbles"


def test_single_links(spark):
    b = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3)], "m_ctg long, s_ctg long")
    assert sorted(tuple(r) for r in bf.single_link_pairs(b).collect()) == [(1, 1), (3, 3)]


def _strands(spark, rows):
    ev = spark.createDataFrame(rows, "m_ctg long, s_ctg long, positive long, negative long")
    comps = ag.contig_components(ev.select("m_ctg", "s_ctg"))
    return {(r.asm, r.ctg): (round(r.prob, 6), r.strand) for r in st.relative_strands(ev, comps).collect()}


def test_strands_on_a_tree(spark):
    got = _strands(spark, [(0, 0, 8, 2), (1, 0, 0, 10), (5, 7, 3, 3)])
    assert got == {
        ("m", 0): (1.0, "+"), ("s", 0): (0.8, "+"), ("m", 1): (0.2, "-"), ("m", 5): (1.0, "+"), ("s", 7): (0.5, "?"),
    }


def test_strands_on_a_cycle_average_over_paths(spark):
    got = _strands(spark, [(0, 0, 10, 0), (0, 1, 10, 0), (1, 0, 10, 0), (1, 1, 0, 5)])
    # m1 over s0: 1.0 with evidence 10; over s1: 0.0 with evidence 5
    assert got[("m", 1)] == (round(10 / 15, 6), "+")


def test_compact_chains(spark):
    v = spark.createDataFrame([(i,) for i in range(6)], "vertex long")
    e = spark.createDataFrame([(0, 1, "BOTH"), (1, 2, "BOTH"), (2, 3, "MASTER"), (5, 4, "BOTH"), (3, 5, "SLAVE")], "src long, dst long, kind string")
    member, between = ag.compact_chains(v, e)
    assert sorted((r.vertex, r.chain) for r in member.collect()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4)]
    assert sorted(tuple(r) for r in between.collect()) == [(0, 3, "MASTER"), (3, 4, "SLAVE")]


def _forks(spark, edges):
    ids = sorted({x for e in edges for x in e[:2]})
    v = spark.createDataFrame([(i, 0, 0, i * 100, i * 100) for i in ids], "chain long, m_ctg long, s_ctg long, m_begin long, s_begin long")
    e = spark.createDataFrame(edges, "src long, dst long, kind string, weight double")
    comp = spark.createDataFrame([(i, 0) for i in ids], "vertex long, comp long")
    vs, es = fk.resolve_forks(fk.merge_vertices(v), e, comp)
    flags = {r.vertex: r.asDict() for r in vs.collect()}
    return flags, sorted((r.src, r.dst, r.kind) for r in es.collect())


def test_fork_decided_by_evidence(spark):
    flags, edges = _forks(spark, [(1, 2, "MASTER", 0.95), (1, 3, "SLAVE", 0.05), (2, 4, "MASTER", 0.9)])
    assert edges == [(1, 2, "MASTER"), (2, 4, "MASTER")]
    assert not flags[1]["s_rtail"] and not flags[3]["s_ltail"] and all(f["valid"] for f in flags.values())


def test_undecided_fork_is_cut(spark):
    flags, edges = _forks(spark, [(1, 2, "MASTER", 0.5), (1, 3, "SLAVE", 0.5), (0, 1, "MASTER", 0.5)])
    assert edges == [(0, 1, "MASTER"), (1, 2, "MASTER")]
    assert not flags[1]["valid"] and not flags[3]["s_ltail"]
    flags, edges = _forks(spark, [(1, 2, "MASTER", 0.5), (1, 3, "SLAVE", 0.5), (0, 1, "SLAVE", 0.5)])
    assert edges == [(0, 1, "SLAVE")]
    assert not flags[0]["s_rtail"]


def test_repeat_is_bypassed(spark):
    flags, edges = _forks(
        spark, [(1, 5, "MASTER", 0.9), (2, 5, "SLAVE", 0.4), (5, 7, "MASTER", 0.8), (5, 8, "SLAVE", 0.7)]
    )
    assert edges == [(1, 7, "MASTER"), (2, 8, "SLAVE")]
    assert not flags[5]["valid"]


def test_bubble_component_is_dropped(spark):
    flags, edges = _forks(
        spark, [(1, 2, "MASTER", 0.5), (1, 3, "SLAVE", 0.5), (2, 4, "SLAVE", 0.5), (3, 4, "MASTER", 0.5)]
    )
    assert flags == {} and edges == []


def _reach(spark, pairs, n):
    vertices = spark.createDataFrame([(v, v * 10, v % 3) for v in range(n)], "vertex long, m_ctg long, s_ctg long")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    out = []
    for graph in (edges, ag.reversed_edges(edges)):
        out.append({(r.start, r.asm, r.ctg) for r in ag.next_contigs(vertices, graph, vertices).collect()})
    return out


def _closure(pairs, n):
    near = {v: [] for v in range(n)}
    for a, b in pairs:
        near[a].append(b)
    out = set()
    for v in range(n):
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        out |= {(v, "m", w * 10) for w in seen} | {(v, "s", w % 3) for w in seen}
    return out


def test_reachable_contigs(spark):
    """A chain, a bubble, a ring without a way in, a ring behind a fork, and a lone vertex."""
    pairs = [(0, 1), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (8, 9), (9, 10), (10, 8), (11, 12), (12, 13), (13, 12), (11, 14)]
    forward, back = _reach(spark, pairs, 16)
    assert forward == _closure(pairs, 16)
    assert back == _closure([(b, a) for a, b in pairs], 16)
