"""Strands in components with rings, against explicit paths."""

import math
import random

from contigloom.operators import assembly_graph as ag
from contigloom.operators import strands as st
from contigloom.operators.spanning import best_forest


def _best_tree(edges):
    """Kruskal over {(a, b): (x, weight)}."""
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    tree = []
    for a, b in sorted(edges, key=lambda e: (-edges[e][1], e)):
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            tree.append((a, b))
    groups = {}
    for v in sorted({v for e in edges for v in e}):
        groups.setdefault(root(v), []).append(v)
    return tree, list(groups.values())


def explicit(rows):
    """Every tree path and every path that leaves the tree once, inside each block."""
    edges = {(2 * m, 2 * s + 1): ((p - n) / (p + n), p + n) for m, s, p, n in rows}
    tree, groups = _best_tree(edges)
    near = {}
    for a, b in tree:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    step = lambda u, v: edges[(u, v)] if (u, v) in edges else edges[(v, u)]
    out = {}
    for group in groups:
        top = min(v for v in group if v % 2 == 0)
        path, parent, todo = {top: []}, {}, [top]
        while todo:
            u = todo.pop()
            for v in near[u]:
                if v not in path:
                    path[v], parent[v] = [*path[u], v], u
                    todo.append(v)
        chords = [e for e in edges if e not in tree and e[0] in path]
        ring = {e: set(path[e[0]]) ^ set(path[e[1]]) for e in chords}
        block = {v: v for v in path if v != top}
        for _ in block:
            for e in chords:
                low = min(block[v] for v in ring[e])
                joined = {block[v] for v in ring[e]}
                block = {v: low if b in joined else b for v, b in block.items()}
        y = {top: 1.0}
        for v in sorted(path, key=lambda v: len(path[v]))[1:]:
            own = [u for u in path[v] if block[u] == block[v]]
            ways = [[step(parent[u], u) for u in own]]
            for e in chords:
                if v in ring[e]:
                    near_end, far = e if v in path[e[0]] else (e[1], e[0])
                    below = path[near_end][path[near_end].index(v) + 1 :]
                    ways.append([step(parent[u], u) for u in path[far] if block[u] == block[v]] + [edges[e]] + [step(parent[u], u) for u in below])
            weight = [min(w for _, w in way) for way in ways]
            mean = sum(w * math.prod(x for x, _ in way) for w, way in zip(weight, ways)) / sum(weight)
            y[v] = y[parent[own[0]]] * mean
        out |= {("m" if v % 2 == 0 else "s", v // 2): (1 + x) / 2 for v, x in y.items()}
    return out


def strands(spark, rows):
    ev = spark.createDataFrame(rows, "m_ctg long, s_ctg long, positive long, negative long")
    comps = ag.contig_components(ev.select("m_ctg", "s_ctg"))
    return {(r.asm, r.ctg): (r.prob, r.strand) for r in st.relative_strands(ev, comps).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, p in want.items():
        assert abs(got[k][0] - p) < 1e-9, k
        assert got[k][1] == ("?" if abs(p - 0.5) < 1e-11 else "+" if p > 0.5 else "-"), k


def test_a_ring_takes_both_ways_round():
    """What the two ways round a ring of four say, by hand."""
    want = explicit([(0, 0, 10, 0), (0, 1, 10, 0), (1, 0, 10, 0), (1, 1, 0, 5)])
    assert abs(want[("m", 1)] - 10 / 15) < 1e-12


def rings_in_a_row():
    return [
        (0, 0, 9, 1), (0, 1, 10, 0), (1, 0, 8, 2), (1, 1, 0, 5), (1, 2, 7, 0), (2, 2, 3, 1), (2, 3, 0, 9), (3, 3, 8, 1), (3, 2, 1, 6), (4, 3, 2, 2), (9, 9, 5, 5),
    ]


def random_pairs(seed):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(40), r.randrange(40)) for _ in range(90)})
    kinds = [lambda: (r.randint(0, 9), r.randint(1, 9)), lambda: (r.randint(1, 9), 0), lambda: (3, 3), lambda: (0, r.randint(1, 9))]
    return [(m, s, *r.choice(kinds)()) for m, s in pairs]


def all_pairs(n, seed):
    """Millions of simple paths."""
    r = random.Random(seed)
    return [(m, s, *((9, r.randint(0, 3)) if (m + s) % 3 else (r.randint(0, 3), 9))) for m in range(n) for s in range(n)]


def test_rings_tails_zeros_random_and_dense_graphs(spark):
    """Components of each kind side by side; none is capped."""
    rows = [(m + 1000 * k, s + 1000 * k, p, n) for k, graph in enumerate([rings_in_a_row(), random_pairs(5), random_pairs(8), all_pairs(10, 6)]) for m, s, p, n in graph]
    same(strands(spark, rows), explicit(rows))


def test_best_forest_equals_kruskal(spark):
    r = random.Random(7)
    edges = {tuple(sorted(r.sample(range(80), 2))): (0.0, r.randint(1, 4)) for _ in range(300)}
    df = spark.createDataFrame([(a, b, w) for (a, b), (_, w) in edges.items()], "a long, b long, weight long").repartition(4)
    assert sorted(tuple(e) for e in best_forest(df).collect()) == sorted(_best_tree(edges)[0])
