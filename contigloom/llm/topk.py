"""Exact top-k inner products by a pivot-distance index.

A vector x gets one more coordinate, sqrt(M - |x|^2), M being the largest |x|^2,
and a query 0; then the largest inner product is the smallest distance.  Every
vector is keyed by its nearest pivot and its distance to it, in annuli of equal
width.  For a query at distance d from a pivot, no vector of the annulus [lo, hi]
is nearer than max(lo - d, d - hi, 0) (triangle inequality).

A query first visits the annuli with the best bounds until they hold enough
vectors; its k-th best score there is a floor, and it then expands to those
annuli, and only those, whose bound still reaches the floor.  So the result is
exact, whatever the pivots.

Pivots are chosen from a bounded sample (``SAMPLE`` rows by hash); the index
holds every row.  The annuli's borders and counts, at most MOST_PIVOTS * ANNULI
rows, are all the driver sees.  Annuli are cut in parts of about PART vectors,
and queries in blocks, so hot annuli are spread.  Of equal vectors only the
k + 1 with the smallest ids can be results (one may be the query itself), and
only those are indexed.

Components become floor(1024 * x) as long.  Vectors that are null, empty of id,
or hold null or non-finite components take no part; a shorter vector counts as
padded by 0; repeated rows of one id and vector count once; rows that share an
id with the query are not its candidates.  Ties go to the smaller id.  Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigloom.llm.shared import stored

SAMPLE = 2048
MOST_PIVOTS = 128
ANNULI = 8
PART = 4096


def whole_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
        .distinct()
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy()
    if (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(column), dim), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        out[i, :n] = values[at[i] : at[i + 1]]
    return out


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far-apart rows of the sample, then a few averaging rounds."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(5):
        home = _distances(sample, pivots).argmin(axis=1)
        pivots = np.array([sample[home == i].mean(axis=0) if (home == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def _keyed(pivots: np.ndarray, width: float, most: float, dim: int):
    def run(batches):
        for batch in batches:
            far = _distances(_lifted(_matrix(batch.column(1), dim), most), pivots)
            home, near = far.argmin(axis=1), far.min(axis=1)
            ring = np.minimum((near / width).astype(np.int64), ANNULI - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home * ANNULI + ring), pa.array(near)], ["vec_id", "v", "cell", "near"]
            )

    return run


class _Cells:
    """Borders and counts of the annuli; what a query can still find in each."""

    def __init__(self, rows, pivots: np.ndarray, most: float, dim: int):
        self.cell, self.lo, self.hi, self.n, self.parts = (np.array([r[i] for r in rows]) for i in range(5))
        self.pivots, self.most, self.dim = pivots, most, dim

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with each annulus's vectors."""
        q = np.column_stack([queries.astype(np.float64), np.zeros(len(queries))])
        d = _distances(q, self.pivots)[:, self.cell // ANNULI]
        nearest = np.maximum(np.maximum(self.lo - d, d - self.hi), 0)
        square = (q * q).sum(axis=1)[:, None]
        bound = (square + self.most - nearest**2) / 2
        return bound + 1e-6 * (1 + square + self.most)  # for rounding


def _visits(cells: _Cells, k: int, first: bool):
    """(cell, part, query, v, floor) of what each query visits; ``first``: the best annuli, else what remains above its floor."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bound = cells.bounds(_matrix(part.column(1), cells.dim))
                by = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(cells.n[by], axis=1) - cells.n[by]
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, by, before <= 2 * k, axis=1)
                if first:
                    go = early
                else:
                    floor = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    go = ~early & (bound >= np.where(np.isnan(floor), -np.inf, floor)[:, None])
                q, c = np.nonzero(go)
                n = cells.parts[c]
                q, c = np.repeat(q, n), np.repeat(c, n)
                nth = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.cell[c]), pa.array(nth), part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q))],
                    ["cell", "part", "query_id", "q"],
                )

    return run


def _best(k: int, dim: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            by = np.argsort(ids, kind="stable")
            ids, v = ids[by], _matrix(left.column("v").combine_chunks(), dim)[by]
            queries, q = right.column("query_id").to_numpy(), _matrix(right.column("q").combine_chunks(), dim)
            exact = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim < 2**53
            for at in range(0, len(q), 512):
                some = q[at : at + 512]
                scores = np.rint(some.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if exact else some @ v.T
                for i, own in enumerate(scores):
                    other = np.flatnonzero(ids != queries[at + i])
                    best = other[np.argsort(-own[other], kind="stable")[:k]]  # ids rise, so ties keep the smaller
                    out["query_id"] += [queries[at + i]] * len(best)
                    out["vec_id"] += ids[best].tolist()
                    out["score"] += own[best].tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return run


def _found(index: DataFrame, visits: DataFrame, blocks: int, k: int, dim: int) -> DataFrame:
    """Up to k results of each query in each part of an annulus."""
    visits = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    held = index.select("cell", "part", "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    keys = ["cell", "part", "block"]
    return held.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_best(k, dim), "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): both tables are (vec_id, v) with v array<long>."""
    spark = vectors.sparkSession
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = stored(vectors.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dim, most = kept.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    asked, q_dim = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, q_dim, 1)
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    lifted = _lifted(_matrix(sample.column("v").combine_chunks(), dim), most)
    pivots = _pivots(lifted, min(MOST_PIVOTS, max(4, n // (ANNULI * PART // 8))))
    width = max(float(_distances(lifted, pivots).min(axis=1).max()) * 1.25 / ANNULI, 1e-9)
    keyed = stored(kept.mapInArrow(_keyed(pivots, width, most, dim), "vec_id long, v array<long>, cell long, near double"), "keyed")
    parts = F.ceil(F.count("*") / F.lit(PART)).cast("long")
    rings = keyed.groupBy("cell").agg(F.min("near").alias("lo"), F.max("near").alias("hi"), F.count("*").alias("n"), parts.alias("parts"))
    rows = [tuple(r) for r in rings.orderBy("cell").collect()]  # at most MOST_PIVOTS * ANNULI
    cells = _Cells(rows, pivots, most, dim)
    sized = F.broadcast(spark.createDataFrame([(r[0], r[4]) for r in rows], "cell long, parts long"))
    index = keyed.join(sized, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "vec_id", "v")
    blocks = int(asked // PART + 1)
    sent = "cell long, part long, query_id long, q array<long>"
    first = stored(_ranked(_found(index, queries.mapInArrow(_visits(cells, k, True), sent), blocks, k, dim), k), "first")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    more = queries.join(floors, "vec_id", "left").select("vec_id", "v", "floor").mapInArrow(_visits(cells, k, False), sent)
    both = first.drop("rank").unionByName(_found(index, more, blocks, k, dim))
    return _ranked(both, k).select("query_id", "rank", "vec_id", "score")
