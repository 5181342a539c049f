"""Shards by jump consistent hashing, with gapless places inside each shard.

A key's shard follows from the key and the number of shards alone: a linear
congruential sequence seeded with the key gives the rising shard counts at which
it would move, and the last one below the number of shards is its shard.  No
ring table exists, and a shard more takes 1 / (n + 1) of the keys, all of them
into itself.

``assign`` is row-local.  ``with_slots`` sorts narrow rows by range, counts the
rows of each shard in each partition and adds the counts of the partitions
before, so neither a shard nor a key that holds a third of all rows is one task.
``write`` puts whole rows into a folder a shard, ``moved`` gives the rows that
other shard counts move.

Integer keys are taken as they are (modulo 2**64); any other kind by its
xxhash64; a null key counts as 0.  Rows with equal keys go to one shard, which
no method keyed by them alone can avoid.  Repeated rows each get a slot, in any
order among themselves; a null text has no bytes and the crc32 of none.  An
empty table gives an empty table.  Columns named like the added ones are
replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from contigloom.llm.shared import stored

#: Fixed values of the published method.
MULTIPLIER = 2862933555777941757
DRAWS = 31  # bits of a draw

_ROWS = 33  # bits of a row's number in its partition, as monotonically_increasing_id lays them out


def jump(keys: np.ndarray, *shards: int) -> list[np.ndarray]:
    """Shard of each key (uint64) for each of the shard counts."""
    state = keys.astype(np.uint64, copy=True)
    out = [np.zeros(len(keys), np.int32) for _ in shards]
    live, at = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    most = max(shards)
    while len(live):
        state = state * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state >> np.uint64(64 - DRAWS)).astype(np.float64) + 1.0
        with np.errstate(over="ignore"):
            to = np.floor((at + 1).astype(np.float64) * (float(1 << DRAWS) / draw))
        go = to < most
        live, state, at = live[go], state[go], to[go].astype(np.int64)
        for n, own in zip(shards, out):
            below = at < n
            own[live[below]] = at[below]
    return out


def key_of(docs: DataFrame, name: str) -> Column:
    """The long that stands for a key; null counts as 0."""
    plain = isinstance(docs.schema[name].dataType, IntegralType)
    return F.when(F.col(name).isNull(), 0).otherwise(F.col(name).cast("long") if plain else F.xxhash64(name))


def _shards(*shards: int):
    if min(shards) < 1:
        raise ValueError("a table needs one shard at least")

    @F.pandas_udf(", ".join(f"s{i} int" for i in range(len(shards))))
    def run(keys: pd.Series) -> pd.DataFrame:
        found = jump(keys.to_numpy(np.int64).view(np.uint64), *shards)
        return pd.DataFrame({f"s{i}": s for i, s in enumerate(found)})

    return run


def assign(docs: DataFrame, key: str, shards: int) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (with one shard more), row by row."""
    found = docs.withColumn("_jump", _shards(shards, shards + 1)(key_of(docs, key)))
    return found.withColumns({"shard": F.col("_jump.s0"), "grown_shard": F.col("_jump.s1")}).drop("_jump")


def moved(docs: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """The rows of ``docs`` that ``after`` shards instead of ``before`` put elsewhere: ``from_shard``, ``to_shard``."""
    found = docs.withColumn("_jump", _shards(before, after)(key_of(docs, key)))
    both = found.withColumns({"from_shard": F.col("_jump.s0"), "to_shard": F.col("_jump.s1")}).drop("_jump")
    return both.where("from_shard <> to_shard")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 ... in each ``shard``, by ``order`` (nulls first).

    ``rows`` is read twice (once to find the ranges); store it where it costs much.
    """
    rows = rows.drop("slot").withColumn("_tie", F.monotonically_increasing_id())  # splits equal rows among partitions
    by = ["shard", *order, "_tie"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = stored(dealt.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part, nth = F.shiftright("_place", _ROWS).alias("_part"), F.col("_place").bitwiseAND((1 << _ROWS) - 1)
    runs = placed.groupBy("shard", part).agg(F.min(nth).alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    # shards lie one after another, so there are fewer runs than partitions and shards together
    found = placed.withColumn("_part", part).join(F.broadcast(runs), ["shard", "_part"])
    return found.withColumn("slot", nth - F.col("_first") + F.col("_before")).drop("_part", "_place", "_first", "_before")


def digest(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents with columns doc_id and text."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = with_slots(stored(assign(narrow, "doc_id", shards), "sharded"), ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write(docs: DataFrame, key: str, shards: int, path: str) -> DataFrame:
    """Write the rows of ``docs`` to ``path/shard=N/`` in order of the key; returns what lies there: (shard, rows).

    A shard is several files, each a range of keys; a key with many rows is split among files.
    """
    by = ["shard", key, "_tie"]
    dealt = assign(docs, key, shards).drop("grown_shard").withColumn("_tie", F.monotonically_increasing_id())
    dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("rows"))
