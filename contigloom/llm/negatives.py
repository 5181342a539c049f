"""Hard negatives of anchors: different-label rows whose score lies in a window below a positive's.

Scores are integer inner products.  They come from tiles (up to ``SIDE`` anchors
by up to ``SIDE`` candidates) that are multiplied by Strassen's recursion on
int64 matrices: tiles are padded with zeros to even halves, seven products of
half the size replace eight, and all sums are exact (int64 wraps modulo 2**64,
so what cancels in between does no harm where the score itself fits).

Two passes over tiles, each leaving heaps that merge in any order:

1. positives: anchors, in blocks of one label, meet the candidates of that
   label; the k best of each anchor are kept;
2. windows: anchors, in blocks of any labels, meet all candidates; each positive
   keeps its best different-label rows inside its window.

A block of anchors is sent to ``splits`` tasks and the candidates are dealt
among these by hash, so neither a hot label nor a hot vector fills one task; a
task streams its candidates and holds one block's anchors and heaps.  Scores are
never stored.

Rows with a null id, label or vector, or a null or non-finite component, take no
part.  Shorter vectors count as padded by 0.  Ties go to the smaller id.  An
anchor leaves out its own row only: repeated rows and other rows of its id are
candidates (of equal rows only the first few can be results, and only those are
shipped), and an anchor that stands in several equal rows gives its results as
often.  Anchors without positives, and positives whose window is empty, give no
rows.  Empty tables give an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigloom.llm.shared import stored

SIDE = 1024
LEAF = 16  # below this a half is multiplied directly
BLOCK = 4096  # anchors held by a task
SHARE = 1 << 18  # candidates streamed by a task


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices, modulo 2**64."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= LEAF:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        padded = strassen(np.pad(a, ((0, n % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, m % 2))))
        return padded[:n, :m]
    h, i, j = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    m6 = strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((n, m), np.int64)
    out[:h, :j], out[:h, j:] = m1 + m4 - m5 + m7, m3 + m5
    out[h:, :j], out[h:, j:] = m2 + m4, m1 - m2 + m3 + m6
    return out


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    taking_part = named.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(F.forall("x", finite))
    return taking_part.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


class Heap:
    """The ``size`` best (score, id) of each of ``n`` owners: scores fall, ties rise by id."""

    def __init__(self, n: int, size: int):
        self.score = np.full((n, size), np.iinfo(np.int64).min)
        self.id = np.full((n, size), np.iinfo(np.int64).max)
        self.n = np.zeros(n, np.int64)

    def merge(self, owners: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Take what is allowed of one tile: row i of it belongs to owners[i]."""
        size = self.score.shape[1]
        full = self.n[owners] == size
        allowed &= ~full[:, None] | (scores >= self.score[owners, -1][:, None])
        row, col = np.nonzero(allowed)
        if not len(row):
            return
        held = np.arange(size) < self.n[owners][:, None]
        r, c = np.nonzero(held)
        every = np.concatenate([row, r]), np.concatenate([scores[row, col], self.score[owners[r], c]]), np.concatenate([ids[col], self.id[owners[r], c]])
        by = np.lexsort((every[2], ~every[1], every[0]))
        row, score, one = (x[by] for x in every)
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, score, one, nth = (x[nth < size] for x in (row, score, one, nth))
        self.score[owners[row], nth], self.id[owners[row], nth] = score, one
        self.n[owners] = np.maximum(self.n[owners], np.bincount(row, minlength=len(owners)))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, nth = np.nonzero(np.arange(self.score.shape[1]) < self.n[:, None])
        return owner, self.score[owner, nth], self.id[owner, nth]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[pa.RecordBatch]]]:
    """(anchors, candidates as they come) of each key; rows are sorted by key, anchors before candidates."""
    slices = ((batch.slice(at, SIDE), batch) for batch in batches for at in range(0, batch.num_rows, SIDE))
    kept: list[pa.RecordBatch] = []

    def runs(batch):
        key = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield tuple(key[:2, lo]), bool(key[2, lo]), batch.slice(lo, hi - lo)

    pieces = (piece for part, _ in slices for piece in runs(part))
    ahead = next(pieces, None)

    def candidates(key):
        nonlocal ahead
        while ahead is not None and ahead[0] == key and ahead[1]:
            yield ahead[2]
            ahead = next(pieces, None)

    while ahead is not None:
        key, kept = ahead[0], []
        while ahead is not None and ahead[0] == key and not ahead[1]:
            kept.append(ahead[2])
            ahead = next(pieces, None)
        anchors = pa.Table.from_batches(kept).combine_chunks().to_batches()[0] if kept else None
        for piece in candidates(key):
            if anchors is not None:
                yield anchors, piece, key
        if anchors is not None:
            yield anchors, None, key


def _found(dim: int, size: int, windows: tuple[int, int] | None):
    """Heaps of each block; with ``windows`` (percent) of its anchors' positives, else of the anchors."""

    def run(batches):
        heap = None
        for anchors, piece, _ in _blocks(batches):
            if heap is None:
                own, label, row = (anchors.column(c).to_numpy() for c in ("vec_id", "label", "row"))
                v = _matrix(anchors.column("v"), dim)
                of, wanted = np.arange(len(own)), None
                if windows is not None:
                    listed = anchors.column("positives")
                    of = np.repeat(of, np.asarray(listed.value_lengths()))
                    wanted = listed.flatten().field("score").to_numpy()
                heap = Heap(len(of), size)
            if piece is None:
                owner, score, one = heap.rows()
                nth = of_place(of)[owner]
                columns = [pa.array(x) for x in (row[of[owner]], nth, score, one)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "nth", "score", "id"])
                heap = None
                continue
            ids, its_label, its_row, copy = (piece.column(c).to_numpy() for c in ("vec_id", "label", "row", "copy"))
            across = np.ascontiguousarray(_matrix(piece.column("v"), dim).T)
            for at in range(0, len(own), SIDE):
                some = slice(at, at + SIDE)
                scores = strassen(v[some], across)
                same = label[some][:, None] == its_label
                if windows is None:
                    same &= ~((row[some][:, None] == its_row) & (own[some][:, None] == ids) & (copy == 1))
                    heap.merge(of[some], scores, ids, same)
                else:
                    lo, hi = np.searchsorted(of, [at, at + SIDE])
                    for first in range(lo, hi, SIDE):
                        who = np.arange(first, min(first + SIDE, hi))
                        its = scores[of[who] - at]
                        inside = ~same[of[who] - at] & (windows[0] * wanted[who][:, None] <= 100 * its) & (100 * its <= windows[1] * wanted[who][:, None])
                        heap.merge(who, its, ids, inside)

    return run


def of_place(of: np.ndarray) -> np.ndarray:
    """Number of each entry among those of equal value; ``of`` rises."""
    return np.arange(len(of)) - np.searchsorted(of, of)


def _met(anchors: DataFrame, candidates: DataFrame, dim: int, size: int, windows: tuple[int, int] | None) -> DataFrame:
    """Heap rows (row, nth, score, id): both tables carry ``key``, ``split`` and the columns of a vector."""
    common = ["key", "split", "is_candidate", "vec_id", "label", "row", "copy", "v"]
    extra = "array<struct<score:long,id:long>>"
    left = anchors.withColumn("is_candidate", F.lit(0)).withColumn("copy", F.lit(0))
    left = left.select(*common, (F.col("positives") if windows else F.lit(None)).cast(extra).alias("positives"))
    right = candidates.withColumn("is_candidate", F.lit(1)).select(*common, F.lit(None).cast(extra).alias("positives"))
    spark = anchors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = left.unionByName(right).repartition(parts, "key", "split").sortWithinPartitions("key", "split", "is_candidate")
    return dealt.mapInArrow(_found(dim, size, windows), "row long, nth long, score long, id long")


def _merged(heaps: DataFrame, size: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: vec_id, label, v (array<long>).  A negative fits a positive
    where window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score.
    """
    spark = vectors.sparkSession
    most = max(positives, negatives) + 1
    row = F.xxhash64("vec_id", "label", "v")
    equal = vectors.groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"))
    rows = stored(equal.withColumns({"row": row, "is_anchor": is_anchor}), "rows")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(most)).cast("int"))).alias("copy")
    candidates = rows.select("vec_id", "label", "v", "row", copies)
    anchors = rows.where("is_anchor").select("vec_id", "label", "v", "row", "copies")
    by_hash = lambda of, among: F.pmod(F.xxhash64(F.col(of), F.lit(7)), among)
    all_splits = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("split")

    # 1. positives: blocks of one label
    sizes = rows.groupBy("label").agg(
        F.ceil(F.sum(F.col("is_anchor").cast("long")) / F.lit(BLOCK)).alias("blocks"), F.ceil(F.count("*") / F.lit(SHARE)).alias("splits")
    )
    sizes = stored(sizes.where("blocks > 0"), "labels")
    dealt = anchors.join(sizes, "label").withColumn("block", by_hash("row", F.col("blocks")))
    to = lambda df, *more: df.withColumn("key", F.xxhash64("label", "block")).select("*", *more)
    asked = to(dealt, all_splits(F.col("splits")))
    met = candidates.join(sizes, "label").withColumn("split", F.pmod(F.xxhash64("row", "copy"), F.col("splits")))
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    best = _merged(_met(asked, to(met), dim, positives, None), positives, "row")
    listed = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("score"), F.col("id")))).alias("p"))
    listed = listed.select("row", F.transform("p", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("positives"))
    owned = stored(anchors.join(listed, "row"), "positives")

    # 2. windows: blocks of any labels
    blocks = owned.count() // BLOCK + 1
    splits = n // SHARE + 1
    asked = owned.withColumn("key", by_hash("row", F.lit(blocks))).select("*", all_splits(F.lit(splits).cast("long")))
    met = candidates.withColumn("split", F.pmod(F.xxhash64("row", "copy"), F.lit(splits)))
    met = met.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = _merged(_met(asked, met, dim, negatives, window), negatives, "row", "nth")
    every = found.join(owned.select("row", F.col("vec_id").alias("anchor_id"), "copies", "positives"), "row")
    of = F.element_at("positives", F.col("nth").cast("int") + 1)
    every = every.withColumn("of", of).withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return every.select(
        "anchor_id", F.col("of.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("of.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
