"""Benchmark decontamination by spaced-seed hashing.

A seed is a hash of the words under a fixed mask that ignores some places, so a
substituted word there does not hide an overlap.  Seeds of all benchmark texts
and of all documents are joined; a joint seed gives a diagonal (document
position less item position), and on each diagonal the words themselves are
aligned.  An overlap is a stretch of at least ``min_words`` equal words (all
words of a shorter item) with a share of ``min_share`` of equal words; of those
on a diagonal the one with the most equal words beyond that share is returned.

A bitmap of fixed size built from the benchmark's seeds only thins out which
seeds of a document enter the join.  The masks miss nothing that is accepted:
every row of equal and different words with at least 8 equal ones and a share of
0.75 has one of them on equal words only.  Items of fewer words, of which all
must be equal, are sought as they stand, from ``SHORTEST`` words on.

Words are runs of letters, digits and non-ASCII, A-Z lower-cased, compared by
64-bit hashes.  Null and empty texts overlap with nothing, in either table; so
do items of fewer than SHORTEST words.  Equal items are reported under their
smallest id, items without id not at all.  Repeated rows of documents give
repeated overlaps; a null document id stays null.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigloom.llm import words as W
from contigloom.llm.shared import Bitmap, stored

_U = np.uint64
#: 6 words each.  Of the rows of SPAN or more equal words with a share of MIN_SHARE that hold no smaller such row (133 of
#: them, up to 16 words long) each has one of these masks on equal words.
MASKS = ("111111", "11101011", "11010111", "11101101", "110110101", "101001111", "1110010011", "1101000111", "1110011001", "1101101001")
#: Shorter items are sought as they stand.
SPAN = 8
MIN_SHARE = 0.75
SHORTEST = 3


def _places(mask: str) -> np.ndarray:
    """Word multipliers of a mask, 0 where it ignores; masks do not share hashes."""
    return W.constants(len(mask), 16 + int("1" + mask, 2)) * np.array([c == "1" for c in mask], _U)


def _item_words(batches):
    for batch in batches:
        for lo, hi, offsets, hashes in W.hash_words(batch.column(1), W.ALNUM):
            words = [hashes[a:b].view(np.int64) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words, pa.list_(pa.int64()))], ["item_id", "item_words"])


def _item_seeds(batches):
    """A mask for each item's length at every place it fits."""
    for batch in batches:
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1)):
            w = np.array(words.values.to_numpy(zero_copy_only=False), np.int64).view(_U)
            masks = MASKS if len(w) >= SPAN else ("1" * len(w),)
            seeds = [W.windows(w, _places(m)).view(np.int64) for m in masks]
            n = [len(s) for s in seeds]
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * sum(n), pa.int64()), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])), pa.array(np.concatenate(seeds))],
                ["item_id", "at", "seed"],
            )


def _hits(masks: list[str], wanted: Bitmap):
    """Documents with a seed in the bitmap: their words and those seeds with their places."""
    places = [_places(m) for m in masks]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, offsets, hashes in W.hash_words(batch.column(1), W.ALNUM):
                ends = np.repeat(offsets[1:], np.diff(offsets))  # of the text of each word
                at, seeds = [], []
                for p in places:
                    all_ = W.windows(hashes, p)
                    ok = np.flatnonzero(wanted.holds(all_.view(np.int64)))
                    ok = ok[ok + len(p) <= ends[ok]]
                    at.append(ok)
                    seeds.append(all_[ok])
                at, seeds = np.concatenate(at), np.concatenate(seeds)
                by = np.argsort(at, kind="stable")
                at, seeds = at[by], seeds[by]
                cut = np.searchsorted(at, offsets)
                rows = np.flatnonzero(np.diff(cut))
                if len(rows):
                    part = lambda x, o: pa.array([x[o[r] : o[r + 1]].view(np.int64) for r in rows], pa.list_(pa.int64()))
                    local = at - np.repeat(offsets[:-1], np.diff(cut))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows + lo)), pa.array(rows + lo), part(hashes, offsets), part(local, cut), part(seeds, cut)],
                        ["doc_id", "nth", "words", "at", "seeds"],
                    )

    return run


def _best_stretch(equal: np.ndarray, least: int, min_share: float) -> tuple[int, int] | None:
    """[start, end) of the stretch with the most equal words beyond ``min_share`` of its length, among those of ``least`` equal words."""
    n = np.concatenate([[0], np.cumsum(equal)])
    beyond = n - min_share * np.arange(len(n))
    low = np.minimum.accumulate(beyond)
    last = np.searchsorted(n, n - least, side="right") - 1  # the last start that leaves enough equal words, for each end
    ends = np.flatnonzero(last >= 0)
    if not len(ends):
        return None
    most = beyond[ends] - low[last[ends]]
    end = int(ends[np.argmax(most)])
    if most.max() < -1e-9:
        return None
    return int(np.argmax(beyond[: last[end] + 1] == low[last[end]])), end


def _verified(min_words: int, min_share: float):
    names = ["doc_id", "text_key", "item_id", "doc_word", "item_word", "n_words", "n_equal"]

    def run(batches):
        for batch in batches:
            out = []
            for doc, key, item, diagonal, mine, items in zip(*(batch.column(c) for c in ("doc_id", "text_key", "item_id", "diagonal", "part", "item_words"))):
                d = int(diagonal.as_py())
                mine, items = mine.values.to_numpy(zero_copy_only=False), items.values.to_numpy(zero_copy_only=False)
                shift = max(0, -d)  # the item may begin before the document
                equal = mine == items[shift : shift + len(mine)]
                stretch = _best_stretch(equal, min(min_words, len(items)), min_share)
                if stretch:
                    a, b = stretch
                    n = int(equal[a:b].sum())
                    out.append((doc.as_py(), key.as_py(), item.as_py(), max(0, d) + a, shift + a, b - a, n))
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = SPAN, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, text_key, item_id, doc_word, item_word, n_words, n_equal), one row per document, item and diagonal.

    Word places count from 0; text_key is xxhash64 of the text.
    """
    if min_words < SPAN or min_share < MIN_SHARE:
        raise ValueError(f"the masks find all overlaps of at least {SPAN} words and a share of {MIN_SHARE}, not of less")
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .where("item_id IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(_item_words, "item_id long, item_words array<long>")
        .where(F.size("item_words") >= SHORTEST)
        .groupBy("item_words")
        .agg(F.min("item_id").alias("item_id"))
        .select("item_id", "item_words")
    )
    items = stored(items, "items")
    lengths = items.where(F.size("item_words") < SPAN).select(F.size("item_words").alias("n")).distinct().collect()  # at most SPAN rows
    seeds = stored(items.mapInArrow(_item_seeds, "item_id long, at int, seed long"), "seeds")
    masks = [*MASKS, *("1" * r.n for r in lengths)]
    wanted = Bitmap.of(seeds, "seed")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc_id"), "text").mapInArrow(
        _hits(masks, wanted), "doc_id struct<doc_id:long,text_key:long>, nth long, words array<long>, at array<long>, seeds array<long>"
    )
    # stored, so that the number a row gets here is the same for both uses below
    found = stored(found.select("doc_id.doc_id", "doc_id.text_key", "words", "at", "seeds", F.monotonically_increasing_id().alias("row")), "hits")
    hits = found.select("row", F.explode(F.arrays_zip("at", "seeds")).alias("hit")).select("row", F.col("hit.at").alias("doc_at"), F.col("hit.seeds").alias("seed"))
    diagonals = hits.join(seeds, "seed").select("row", "item_id", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct()
    pairs = diagonals.join(items, "item_id")
    start = F.greatest("diagonal", F.lit(0))
    part = F.slice("words", (start + 1).cast("int"), (F.col("diagonal") + F.size("item_words") - start).cast("int"))
    aligned = pairs.join(found.select("row", "doc_id", "text_key", "words"), "row").select("doc_id", "text_key", "item_id", "diagonal", part.alias("part"), "item_words")
    return aligned.mapInArrow(
        _verified(min_words, min_share), "doc_id long, text_key long, item_id long, doc_word long, item_word long, n_words long, n_equal long"
    )


def without_overlaps(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have no overlap in ``found``."""
    leaked = found.select(F.col("doc_id").alias("_leaked"), F.col("text_key").alias("_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_leaked")) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(F.col("_key"))
    return docs.join(leaked, same, "left_anti")
