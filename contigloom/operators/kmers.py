"""Seeds: the diagonals that share the most words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from contigloom.functions import banded
from contigloom.operators.sequence_tiles import TILE
from contigloom.operators.tiled import exclusive_prefix, ordered_neighbours
from contigloom.session import cut_lineage, spread

WORD = 20
_CHUNK = 256


def words(df: DataFrame, id_col: str, seq: Column, word: int = WORD) -> DataFrame:
    """The words of a sequence as stretches (id, at, bases, parts).

    A stretch holds the words that begin at its places ``at``, ``at + 1``, ...; ``parts`` is
    the number of stretches of the sequence.  Single words would take 20 times the room.
    """
    overlapping = rf"(?s)(?=(.{{1,{TILE + word - 1}}})).{{1,{TILE}}}"
    cut = F.filter(F.regexp_extract_all(seq, F.lit(overlapping), F.lit(1)), lambda p: F.length(p) >= word)
    parts = df.select(id_col, cut.alias("_cut")).select(id_col, F.size("_cut").alias("parts"), F.posexplode("_cut").alias("_n", "bases"))
    return parts.select(id_col, (F.col("_n").cast("long") * TILE).alias("at"), "bases", "parts")


def _listed(stretches: DataFrame, id_col: str, word: int = WORD) -> DataFrame:
    """(id, word, at) for every word.

    A stretch is cut in one pass into short overlapping pieces, because a
    substring far into a string costs its distance from the start.
    """
    overlapping = rf"(?s)(?=(.{{1,{_CHUNK + word - 1}}})).{{1,{_CHUNK}}}"
    pieces = (
        stretches.select(id_col, "at", F.posexplode(F.regexp_extract_all("bases", F.lit(overlapping), F.lit(1))).alias("n", "piece"))
        .select(id_col, F.struct((F.col("at") + F.col("n").cast("long") * _CHUNK).alias("base"), "piece").alias("p"))
        .where(F.length("p.piece") >= word)
    )
    return spread(pieces).select(
        id_col,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.length("p.piece") - word),
                lambda i: F.struct(F.substring(F.col("p.piece"), i + 1, F.lit(word)).alias("word"), (F.col("p.base") + i).alias("at")),
            )
        ).alias("w"),
    ).select(id_col, "w.word", "w.at")


def _runs(positions: DataFrame, id_col: str) -> DataFrame:
    """Places of one word at equal distances as (begin, step, len); a place alone has len 1."""
    keys = [id_col, "word"]
    near = ordered_neighbours(positions, keys, "at", [F.col("at")], ["at"]).withColumn("gap", F.col("at") - F.col("prev_at"))
    near = ordered_neighbours(near.select(*keys, "at", "gap"), keys, "at", [F.col("at")], ["gap"])
    opens = ~F.coalesce(F.col("gap") == F.col("prev_gap"), F.lit(False))
    marked = near.select(*keys, "at", "gap", F.when(opens, F.col("at")).alias("open"))
    labelled = exclusive_prefix(marked, keys, "at", {"last": ("max", "open")})
    runs = labelled.groupBy(*keys, F.coalesce("open", "last").alias("begin")).agg(F.count("*").alias("len"), F.max("gap").alias("step"))
    return runs.withColumn("step", F.when(F.col("len") > 1, F.col("step")).otherwise(1))


def _run_diagonals(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Hits per diagonal of repeated words, without listing the pairs of their places.

    Two runs of lengths L and M and one step meet on a trapezoid over every
    step-th diagonal, which four impulses describe; summing the impulses twice
    gives the counts.  Of two runs with unlike steps the shorter one is taken
    place by place.
    """
    ra = _runs(a, id_col)
    rb = _runs(b, id_col).select(id_col, "word", *[F.col(c).alias(f"b_{c}") for c in ("begin", "len", "step")])
    fits = F.expr("len = 1 OR b_len = 1 OR step = b_step")
    met = ra.join(rb, [id_col, "word"]).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.when(fits, 0).otherwise(F.least("len", "b_len") - 1))).alias("i"),
        (~fits & F.expr("len <= b_len")).alias("a_alone"), (~fits & F.expr("len > b_len")).alias("b_alone"),
    )
    met = met.select(
        id_col,
        F.expr("begin + i * IF(a_alone, step, 0)").alias("begin"), F.expr("IF(a_alone, 1, len)").alias("len"),
        F.expr("b_begin + i * IF(b_alone, b_step, 0)").alias("b_begin"), F.expr("IF(b_alone, 1, b_len)").alias("b_len"),
        F.expr("IF(a_alone OR len = 1, b_step, step)").alias("step"),
    )
    low = met.withColumn("d", F.expr("begin - b_begin - (b_len - 1) * step")).withColumn("rest", F.expr("pmod(d, step)"))
    at = F.expr("(d - rest) div step")
    impulse = [F.struct((at + more).alias("k"), F.lit(w).cast("long").alias("w")) for more, w in (
        (F.lit(0), 1), (F.col("len"), -1), (F.col("b_len"), -1), (F.col("len") + F.col("b_len"), 1)
    )]
    impulses = low.select(id_col, "step", "rest", F.explode(F.array(*impulse)).alias("p"))
    keys = [id_col, "step", "rest"]
    points = impulses.groupBy(*keys, F.col("p.k").alias("k")).agg(F.sum("p.w").alias("w")).withColumn("wk", F.col("w") * F.col("k"))
    run = exclusive_prefix(points, keys, "k", {"_s": ("sum", "w"), "_x": ("sum", "wk")})
    run = run.select(*keys, "k", (F.col("_s") + F.col("w")).alias("s"), (F.col("_x") + F.col("wk")).alias("x"))
    spans = ordered_neighbours(run, keys, "k", [F.col("k")], ["k"]).where("next_k > k AND next_k > 0 AND (s <> 0 OR x <> 0)")
    first = F.greatest("k", F.lit(0).cast("long"))
    parts = spans.select(*keys, "s", "x", "next_k", F.explode(F.sequence(first, F.col("next_k") - 1, F.lit(65536).cast("long"))).alias("from"))
    every = parts.select(*keys, "s", "x", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + 65535, F.col("next_k") - 1))).alias("k"))
    counted = every.select(id_col, F.expr("rest + step * k").alias("diag"), ((F.col("k") + 1) * F.col("s") - F.col("x")).alias("hits"))
    return counted.where("hits > 0")


def _stretch_hits(batches):
    """Shared words of two stretches per diagonal."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows, diags, counts = [], [], []
        for k, (a_at, a, b_at, b) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]])):
            diag, hits = banded.shared_codes(*banded.letter_codes(a, b, WORD), a_at - b_at)
            rows.append(np.full(len(diag), k))
            diags.append(diag)
            counts.append(hits)
        if rows:
            at, diag, hits = [np.concatenate(x).astype(np.int64) for x in (rows, diags, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(diag), pa.array(hits)], names=[batch.schema.names[0], "diag", "hits"])


def diagonal_hits(a_words: DataFrame, b_words: DataFrame, id_col: str) -> DataFrame:
    """(id, diag, hits): shared words per diagonal ``a - b >= 0``.

    Every word is in one stretch, so the hits of two sequences are the sum over
    pairs of their stretches.  Where one sequence is a single stretch, the
    stretches meet; where both have several, which would grow with the product of
    their lengths, their words do.
    """
    a = a_words.select(id_col, F.col("at").alias("a_at"), F.col("bases").alias("a"), F.col("parts").alias("a_parts"))
    b = b_words.select(F.col(id_col).alias("_b"), F.col("at").alias("b_at"), F.col("bases").alias("b"), F.col("parts").alias("b_parts"))
    met = a.join(b, F.col(id_col).eqNullSafe(F.col("_b")) & F.expr("a_parts = 1 OR b_parts = 1")).select(id_col, "a_at", "a", "b_at", "b")
    schema = StructType([a_words.schema[id_col], StructField("diag", LongType()), StructField("hits", LongType())])
    near = met.mapInArrow(_stretch_hits, schema)
    long_a, long_b = [cut_lineage(w.where("parts > 1")) for w in (a_words, b_words)]
    if not (long_a.isEmpty() or long_b.isEmpty()):
        near = near.unionByName(_long_hits(_listed(long_a, id_col), _listed(long_b, id_col), id_col))
    return near.groupBy(id_col, "diag").agg(F.sum("hits").alias("hits"))


def _long_hits(a_words: DataFrame, b_words: DataFrame, id_col: str) -> DataFrame:
    """(id, diag, hits) of listed words (id, word, at).

    One aggregate over both sides finds the shared words and settles those that
    occur once on each side; only repeated words are joined, as runs of places
    at equal distances.
    """
    nothing = F.lit(None).cast("long")
    both = a_words.select(id_col, "word", F.col("at").alias("a"), nothing.alias("b")).unionByName(
        b_words.select(id_col, "word", nothing.alias("a"), F.col("at").alias("b"))
    )
    shared = cut_lineage(
        both.groupBy(id_col, "word")
        .agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.min("a").alias("a"), F.min("b").alias("b"))
        .where("na > 0 AND nb > 0")
    )
    single = shared.where("na = 1 AND nb = 1 AND a >= b").groupBy(id_col, (F.col("a") - F.col("b")).alias("diag")).agg(F.count("*").alias("hits"))
    repeated = shared.where("na > 1 OR nb > 1").select(id_col, "word")
    if repeated.isEmpty():
        return single
    again = _run_diagonals(*[w.join(repeated, [id_col, "word"], "left_semi") for w in (a_words, b_words)], id_col)
    return single.unionByName(again).groupBy(id_col, "diag").agg(F.sum("hits").alias("hits"))


def best_diagonals(a_words: DataFrame, b_words: DataFrame, id_col: str) -> DataFrame:
    """All diagonals that tie for the most shared words."""
    hits = cut_lineage(diagonal_hits(a_words, b_words, id_col))
    top = hits.groupBy(id_col).agg(F.max("hits").alias("top"))
    return hits.join(top, id_col).where("hits = top").select(id_col, "diag", "hits")
