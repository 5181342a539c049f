"""Running aggregates along a coordinate that survive hot keys.

A plain ``sum() OVER (PARTITION BY contig ORDER BY pos)`` sorts a whole contig
in one task.  Here a key is cut into coordinate tiles: each tile is reduced to
one row, the (few) tile rows are scanned in order to get what precedes every
tile, and the detail rows only need a window inside their own tile.  Callers
collapse their rows to one per coordinate first, so a tile never holds more
than ``2 ** bits`` rows, however many reads pile up on it.

There is one way for every size.  The input is read more than once, so it is
checkpointed.  Tile rows grow with the input, so they meet their details by a
shuffle (the hints), which the window inside a tile needs anyway, and are not
collected by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigloom.session import cut_lineage, short_lived

TILE_BITS = 16

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(carried, local)  # both skip NULL


def exclusive_prefix(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: dict[str, tuple[str, str | Column]],
    bits: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add ``out = kind(col)`` over the rows of the same key with a smaller ``pos``.

    ``values`` maps an output name to ``(kind, column)``, kind in sum/max/min, column a name or an expression.
    ``df`` must hold one row per ``(keys, pos)``.  ``stored``: the caller has
    already materialised it.
    """
    keys, bits = list(keys), TILE_BITS if bits is None else bits
    if not stored:
        df = cut_lineage(df)
    tiled = df.withColumn("_tile", F.shiftright(F.col(pos), bits))
    per_tile = tiled.groupBy(*keys, "_tile").agg(
        *[_AGG[kind](col).alias(f"_t_{out}") for out, (kind, col) in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_tile.select(
        *keys,
        "_tile",
        *[_AGG[kind](f"_t_{out}").over(before).alias(f"_c_{out}") for out, (kind, _) in values.items()],
    )
    inside = Window.partitionBy(*keys, "_tile").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    joined = tiled.join(carry.hint("shuffle_hash"), [*keys, "_tile"])
    return joined.select(
        *df.columns,
        *[
            _merge(kind, F.col(f"_c_{out}"), _AGG[kind](col).over(inside)).alias(out)
            for out, (kind, col) in values.items()
        ],
    )


def island_starts(
    df: DataFrame, keys: Sequence[str], start: str, reach: str, out: str, bits: int | None = None
) -> DataFrame:
    """Gaps and islands: label each row with the first coordinate of its island.

    A row opens an island when it starts beyond ``reach + 1`` of everything
    before it, so touching neighbours stay together.  One row per
    ``(keys, start)``, ``reach`` being the last covered coordinate.
    """
    keys, bits = list(keys), TILE_BITS if bits is None else bits
    with short_lived(df) as df:
        tiled = df.withColumn("_tile", F.shiftright(F.col(start), bits))
        before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
        reached = tiled.groupBy(*keys, "_tile").agg(F.max(reach).alias("_far")).select(*keys, "_tile", F.max("_far").over(before).alias("_far"))
        inside = Window.partitionBy(*keys, "_tile").orderBy(start)
        above = inside.rowsBetween(Window.unboundedPreceding, -1)
        seen = tiled.join(reached.hint("shuffle_hash"), [*keys, "_tile"]).withColumn("_reach", _merge("max", F.col("_far"), F.max(reach).over(above)))
        opened = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + 1), F.col(start))
        # the last opening within the tile, by the same shuffle; only the rows before a tile's first one ask earlier tiles
        until = inside.rowsBetween(Window.unboundedPreceding, 0)
        marked = cut_lineage(seen.withColumn("_open", opened).select(*df.columns, "_tile", F.max("_open").over(until).alias(out)))
    per_tile = marked.groupBy(*keys, "_tile").agg(F.max(out).alias("_last"))
    carry = per_tile.select(*keys, "_tile", F.max("_last").over(before).alias("_last"))
    carried = marked.where(F.col(out).isNull()).drop(out).join(carry.hint("shuffle_hash"), [*keys, "_tile"])
    return marked.where(F.col(out).isNotNull()).select(*df.columns, out).unionByName(
        carried.select(*df.columns, F.col("_last").alias(out))
    )


def ordered_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    order: Sequence[Column],
    payload: Sequence[str],
    bits: int | None = None,
) -> DataFrame:
    """Add ``next_<c>`` / ``prev_<c>`` for every payload column, in key order.

    ``order`` must start with ``pos`` ascending.  Rows at the border of a tile
    take the neighbour from the closest non-empty tile.
    """
    keys = list(keys)
    body = F.struct(*payload)
    bits = TILE_BITS if bits is None else bits
    df = cut_lineage(df)
    tiled = df.withColumn("_tile", F.shiftright(F.col(pos), bits))
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order)
    local = tiled.withColumn("_n", F.lead(body).over(inside)).withColumn("_p", F.lag(body).over(inside))
    edges = (
        local.where(F.col("_n").isNull() | F.col("_p").isNull())
        .groupBy(*keys, "_tile")
        .agg(
            F.max(F.when(F.col("_p").isNull(), body)).alias("_first"),
            F.max(F.when(F.col("_n").isNull(), body)).alias("_final"),
        )
    )
    tiles = Window.partitionBy(*keys).orderBy("_tile")
    border = edges.select(
        *keys,
        "_tile",
        F.lead("_first").over(tiles).alias("_bn"),
        F.lag("_final").over(tiles).alias("_bp"),
    )
    joined = local.join(border.hint("shuffle_hash"), [*keys, "_tile"])
    nxt, prv = F.coalesce("_n", "_bn"), F.coalesce("_p", "_bp")
    return joined.select(
        *df.columns,
        *[nxt.getField(c).alias(f"next_{c}") for c in payload],
        *[prv.getField(c).alias(f"prev_{c}") for c in payload],
    )


def number_rows(
    df: DataFrame, key: str, pos: str, order: Sequence[Column], out: str, bits: int | None = None
) -> DataFrame:
    """Dense 0-based numbers in (key, pos, order) sequence without a global sort.

    Counts per key and per tile give the offsets; rows are ranked in their tile.
    """
    bits = TILE_BITS if bits is None else bits
    df = cut_lineage(df)
    tiled = df.withColumn("_tile", F.shiftright(F.col(pos), bits))
    per_tile = tiled.groupBy(key, "_tile").agg(F.count("*").alias("_n"))
    per_key = per_tile.groupBy(key).agg(F.sum("_n").alias("_kn")).withColumn("_all", F.lit(0))
    key_base = exclusive_prefix(per_key, ["_all"], key, {"_kb": ("sum", "_kn")}, bits).select(key, "_kb")
    before = Window.partitionBy(key).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tile_base = per_tile.select(key, "_tile", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_tb"))
    base = tile_base.join(key_base.hint("shuffle_hash"), key).select(key, "_tile", (F.col("_kb") + F.col("_tb")).alias("_base"))
    inside = Window.partitionBy(key, "_tile").orderBy(*order)
    return tiled.join(base.hint("shuffle_hash"), [key, "_tile"]).select(
        *df.columns, (F.col("_base") + F.row_number().over(inside) - 1).cast("long").alias(out)
    )
