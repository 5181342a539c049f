"""Exact histogram of encoded lengths.

Texts are encoded by a public byte-level BPE; the documents are aggregated by
their number of tokens, and running sums over the histogram answer, for every
context limit, how many documents and tokens fit, what truncation leaves, and
quantiles.  The histogram has a row per distinct length.  Its running sums are
taken in tiles of lengths with carried totals, so no task sorts all of it.

The ranks are read by the driver from ``ranks`` (a bounded file) and go to the
tasks with their function.  Null texts count as empty, of length 0.  Repeated
rows count each.  An empty table has an empty histogram, totals 0 and null
quantiles.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_RANKS_BYTES = 16 << 20
TILE = 1024
#: Fixed value: how the public vocabulary cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> bytes:
    if os.path.getsize(path) > MOST_RANKS_BYTES:
        raise ValueError(f"{path} is too large to be sent to every task")
    with open(path, "rb") as file:
        return file.read()


def _encoded(ranks: bytes, pattern: str):
    def run(batches):
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(docs: DataFrame, ranks: bytes, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(ranks, pattern), "doc_id long, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length."""
    return counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def running(hist: DataFrame) -> DataFrame:
    """The histogram with sums from either end.

    docs_up_to and tokens_up_to take in this length; docs_over and tokens_over
    the longer ones; truncated_tokens is what is left of all when every
    document is cut to this length; rank is the share of documents up to here.
    """
    tiled = hist.withColumn("tile", F.floor(F.col("n_tokens") / TILE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    tiles = tiled.groupBy("tile").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    groups = tiles.withColumn("group", F.floor(F.col("tile") / TILE))
    # lengths, tiles of lengths, groups of tiles: each level is scanned in the parts of the next
    tops = groups.groupBy("group").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(
        "group",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"g{c}") for c in "dt"],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in "dt"],
    )
    inside = Window.partitionBy("group").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.select("group", "tile", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"c{c}") for c in "dt"])
    carried = carried.join(tops, "group").select("tile", "all_d", "all_t", (F.col("cd") + F.col("gd")).alias("bd"), (F.col("ct") + F.col("gt")).alias("bt"))
    upto = Window.partitionBy("tile").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = tiled.select("tile", "n_tokens", "n_docs", F.sum("n_docs").over(upto).alias("d"), F.sum("tokens").over(upto).alias("t")).join(carried, "tile")
    docs, tokens = F.col("d") + F.col("bd"), F.col("t") + F.col("bt")
    return sums.select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_up_to"),
        tokens.alias("tokens_up_to"),
        (F.col("all_d") - docs).alias("docs_over"),
        (F.col("all_t") - tokens).alias("tokens_over"),
        (tokens + F.col("n_tokens") * (F.col("all_d") - docs)).alias("truncated_tokens"),
        (docs / F.col("all_d")).alias("rank"),
    )


def totals(hist: DataFrame) -> DataFrame:
    """One row (n_docs, n_tokens)."""
    return hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("n_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length up to which at least that share of documents goes; ``sums`` from running()."""
    return sums.agg(*[F.min(F.when(F.col("rank") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])).alias("q")
    ).select("q.*")


def truncated(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, tokens, cut_docs) for any context limits: tokens left, and documents that lose some."""
    up_to = [F.max(F.when(F.col("n_tokens") <= c, F.col("tokens_up_to"))).alias(f"k{i}") for i, c in enumerate(limits)]
    longer = [F.max(F.when(F.col("n_tokens") > c, F.col("docs_over") + F.col("n_docs"))).alias(f"n{i}") for i, c in enumerate(limits)]
    answers = []
    for i, c in enumerate(limits):
        kept, cut = F.coalesce(f"k{i}", F.lit(0)), F.coalesce(f"n{i}", F.lit(0))
        answers.append(F.struct(F.lit(int(c)).alias("context"), (kept + c * cut).alias("tokens"), cut.alias("cut_docs")))
    return sums.agg(*up_to, *longer).select(F.explode(F.array(*answers)).alias("c")).select("c.*")
