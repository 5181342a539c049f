"""Multi-party perspective rotation of conversations.

For every participant a dialogue is rendered once with that participant as the
assistant and everyone else as a named user; system turns stay system turns.
The mask marks what the assistant says, end mark included, as character spans.

A turn renders alike from the view of each other participant, so a conversation
is cut in chunks of ``chunk`` neighbouring turns and every chunk is rendered by
itself: a conversation of any length is spread over tasks, and one of at most
``chunk`` turns is a single chunk.  Chunks are counted by rank, not by the turn
number, so missing, null or repeated numbers do not make a chunk larger; ranks
are taken in tiles of turn numbers with carried counts.

Order: turn (null first), then role, then text.  A null or blank role is the
participant ``unknown``, a null text is empty; repeated rows are rendered each.
A null conv_id is a conversation like another.  A conversation of system turns
only has no participants and no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contigloom.llm.shared import stored

CHUNK = 512
TILE = 4096
# The marks of the common chat markup.
START, STOP = "<|im_start|>", "<|im_end|>\n"


def _numbered(turns: DataFrame, chunk: int) -> DataFrame:
    """Rows with the chunk they fall in; copies of a row are counted, then spread."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.trim(F.coalesce("role", F.lit(""))) == "", F.lit("unknown")).otherwise(F.trim("role")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tile", F.floor(F.coalesce("turn", F.lit(-1)) / TILE))
    # equal rows are one row with a number of copies, whose order does not matter
    once = rows.groupBy("conv_id", "tile", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    tiles = rows.groupBy("conv_id", "tile").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = tiles.select(F.col("conv_id").alias("_conv"), F.col("tile").alias("_tile"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("conv_id", "tile").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    ranked = once.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = ranked.join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("tile") == F.col("_tile")))
    nth = F.col("first") + F.col("inside")
    spread = placed.withColumn("nth", F.explode(F.sequence(nth, nth + F.col("copies") - 1)))
    return spread.select("conv_id", F.floor(F.col("nth") / chunk).alias("chunk"), "nth", "speaker", "text")


def perspectives(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, perspective, chunk, n_turns, n_own, first_char, text, mask) per conversation, participant and chunk.

    The chunks' texts, one after the other, are the whole dialogue; first_char
    is where a chunk begins in it.  mask: array of (start, end) in characters of
    the whole dialogue, end exclusive.  From a view without turns in a chunk the
    mask is empty.
    """
    rows = _numbered(turns, chunk)
    participants = rows.where("speaker <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("nth", "speaker", "text"))).alias("turns"))  # of ``chunk`` rows
    views = chunks.join(participants, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def header(turn):
        role = F.when(turn["speaker"] == F.col("perspective"), F.lit("assistant"))
        role = role.when(turn["speaker"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), turn["speaker"]))
        return F.concat(F.lit(START), role, F.lit("\n"))

    parts = F.transform(
        "turns",
        lambda t: F.struct(
            header(t).alias("head"), F.concat(t["text"], F.lit(STOP)).alias("body"), (t["speaker"] == F.col("perspective")).alias("own")
        ),
    )
    rendered = views.select("conv_id", "perspective", "chunk", parts.alias("parts"))
    sizes = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda state, p: F.struct(
            (state["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(
                p["own"],
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + F.length(p["head"])).alias("start"), (state["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )
    drawn = stored(
        rendered.select(
            "conv_id",
            "perspective",
            F.col("chunk").cast("long").alias("chunk"),
            F.size("parts").cast("long").alias("n_turns"),
            F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
            F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
            sizes["spans"].alias("mask"),
        ),
        "chunks",
    )
    before = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    lengths = drawn.select("conv_id", "perspective", "chunk", F.length("text").cast("long").alias("n"))
    starts = lengths.select(
        F.col("conv_id").alias("_conv"), F.col("perspective").alias("_view"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_char")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_view")) & (F.col("chunk") == F.col("_chunk"))
    moved = F.transform("mask", lambda m: F.struct((m["start"] + F.col("first_char")).alias("start"), (m["end"] + F.col("first_char")).alias("end")))
    return drawn.join(starts, same).select("conv_id", "perspective", "chunk", "n_turns", "n_own", "first_char", "text", moved.alias("mask"))
