"""Divergence of sources: how differently the (language, source) groups use their language's terms.

Terms are runs of letters and bytes beyond ASCII, A-Z lower-cased.  A language
keeps the terms of at least ``LEAST_DOCS`` of its documents.  A group, and the
language itself, gives each kept term p = 1 + floor(10**9 (count + 2) / (N + 2 V)),
N being its occurrences of kept terms and V the number of them.  Two such
numbers differ by f(p, q) = floor((p - q)**2 / (p + q)).

``audit`` gives, per group, the sum of f against every other source of the
language over all kept terms (part ``pair``), and the terms the group uses most
above its language (part ``term``).

Pairs are priced by pair tasks.  A group's counts are arrays sorted by term id,
cut into slices of at most 2 ** SLICE_BITS ids; for each slice two bundles of up to
about ``BUNDLE`` sources are co-grouped, and each unordered pair is priced in one
merge: galloping search finds the common ids, what is left of either array is
one-sided, and the ids of the slice that neither holds count as absent.  f is
symmetric, so a price holds both ways.  Sums over slices are plain aggregates.
A group with a third of all rows is no more than its terms.

Null text, language and source count as ''.  Groups without terms are listed
with the others; without kept terms all values are 0.  A repeated row is a
document of its own.  Ties go by the item.  An empty table gives an empty
table.  Other columns are ignored.  Whole numbers throughout: exact up to
9 * 10**15 occurrences of a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigloom.llm.shared import stored

LEAST_DOCS = 10
TOP = 10
SLICE_BITS = 16  # a slice has 2 ** 16 ids
BUNDLE = 8
SCALE = 10**9
HELD = 1 << 18  # distinct (group, term) entries a task holds before it passes them on

#: Byte table: letters lower-cased, bytes beyond ASCII as they are, all else a blank.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of whole texts, summed over what a task holds at a time."""
    names = ["lang", "source", "term", "n", "docs"]
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            found = Counter(text.translate(_FOLD).split())
            n.update(found)
            docs.update(found.keys())
            entries += len(n) - before
            if entries > HELD:
                yield from rows()
                held, entries = {}, 0
    yield from rows()


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term with ``count`` of a group's ``total`` occurrences of ``kept`` terms."""
    wide = lambda c: c.cast("decimal(38,0)")
    return 1 + F.call_function("div", wide(count + 2) * F.lit(SCALE), wide(total + 2 * kept)).cast("long")


def _shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same by long division in three steps of 1000, so that nothing overflows."""
    by = total + 2 * kept
    rest, out = count.astype(np.int64) + 2, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def gallop(few: np.ndarray, many: np.ndarray, stride: int = 64) -> np.ndarray:
    """Where each of the rising ids ``few`` would stand in the rising ``many``.

    From where the last stretch of ids ended the step doubles until it passes
    the next one, and only that window is searched.
    """
    out, at = np.empty(len(few), np.int64), 0
    for i in range(0, len(few), stride):
        some = few[i : i + stride]
        step = stride
        while at + step < len(many) and many[at + step] < some[-1]:
            step *= 2
        found = np.searchsorted(many[at : at + step + 1], some) + at
        out[i : i + stride] = found
        at = int(found[-1])
    return out


def merged_price(a, b, width: int) -> int:
    """Sum of f over a slice of ``width`` ids; a, b: (ids, shares of these, share of an absent term)."""
    (ids, p, p0), (other, q, q0) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = gallop(ids, other)
    inside = np.minimum(at, max(len(other) - 1, 0))
    common = other[inside] == ids if len(other) else np.zeros(len(ids), bool)
    alone = np.ones(len(other), bool)
    alone[at[common]] = False
    both = int(price(p[common], q[at[common]]).sum())
    one_sided = int(price(p[~common], q0).sum()) + int(price(p0, q[alone]).sum())
    absent = (width - len(ids) - int(alone.sum())) * int(price(p0, q0).sum())
    return both + one_sided + absent


def _priced(left: pa.Table, right: pa.Table) -> pa.Table:
    """Prices of the unordered pairs between two bundles of sources in one slice."""

    def arrays(rows: pa.Table):
        for r in range(rows.num_rows):
            one = {c: rows.column(c)[r] for c in rows.column_names}
            total, kept = one["total"].as_py(), one["kept"].as_py()
            ids, n = (np.asarray(one[c].values.to_numpy(zero_copy_only=False), np.int64) for c in ("ids", "counts"))
            p = _shares(np.append(n, 0), total, kept)
            yield one["source"].as_py(), (ids, p[:-1], p[-1:]), one["width"].as_py(), one["lang"].as_py()

    out = {"lang": [], "a": [], "b": [], "value": []}
    others = list(arrays(right))
    for source, own, width, lang in arrays(left):
        for other, its, _, _ in others:
            if source < other or left.column("bundle")[0] != right.column("bundle")[0] and source != other:
                out["lang"].append(lang)
                out["a"].append(source)
                out["b"].append(other)
                out["value"].append(merged_price(own, its, width))
    kinds = {"lang": pa.string(), "a": pa.string(), "b": pa.string(), "value": pa.int64()}
    return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})


def pair_prices(counts: DataFrame, vocabulary: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every unordered pair of sources of a language that keeps terms.

    ``counts``: lang, source, id, n; ``vocabulary``: lang, id; ``groups``: lang, source, total, kept.
    """
    slice_of = F.shiftright("id", SLICE_BITS).alias("slice")
    held = counts.groupBy("lang", "source", slice_of).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("held"))
    widths = vocabulary.groupBy("lang", slice_of).agg(F.count("*").cast("int").alias("width"))
    sources = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(BUNDLE)).alias("bundles"))
    dense = groups.where("kept > 0").join(sources, "lang").join(widths, "lang")
    dense = dense.join(held, ["lang", "source", "slice"], "left").select(
        "lang", "slice", "source", "total", "kept", "width", "bundles",
        F.pmod(F.xxhash64("source"), F.col("bundles")).alias("bundle"),
        F.coalesce(F.col("held.id"), F.array().cast("array<long>")).alias("ids"),
        F.coalesce(F.col("held.n"), F.array().cast("array<long>")).alias("counts"),
    )
    dense = stored(dense, "arrays")
    last = F.col("bundles") - 1
    one = dense.withColumn("against", F.explode(F.sequence(F.col("bundle"), last))).withColumn("of", F.col("bundle"))
    two = dense.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bundle")))).withColumn("against", F.col("bundle"))
    keys = ["lang", "slice", "of", "against"]
    parts = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(_priced, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of ``docs``."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    found = docs.select(text.cast("binary"), lang, source).mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    found = found.withColumn("term", F.col("term").cast("string"))
    counts = stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    words = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang"))
    words = words.where(F.col("docs") >= LEAST_DOCS).repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    words = stored(words.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    kept = stored(counts.drop("docs").join(words.drop("docs"), ["lang", "term"]), "kept")
    of_lang = words.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(
        docs.select(lang, source).distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0), "groups"
    )
    prices = stored(pair_prices(kept, words, groups), "prices")
    both = prices.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        prices.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    other = groups.select("lang", F.col("source").alias("item"))
    listed = groups.select("lang", "source").join(other, "lang").where("source <> item")
    pairs = listed.join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    used = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    terms = used.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value")
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = terms.withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(ranked)
