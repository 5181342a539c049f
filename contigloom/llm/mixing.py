"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is domain - language - source.  Weights at a node are shares of what
the node gets, so they are propagated from the root to the leaves; a leaf can
give its tokens up to ``most_epochs`` times.  A node's budget goes to its
children by weight; a child that cannot use its share gives the rest to its
siblings, by their weights, and only what all of them cannot use stays with the
parent's siblings, because a node never gets more than its leaves can give.

Filling is in whole numbers: children are ordered by capacity over weight;
going up, a child is full when its capacity is at most its share of what the
ones before it left, and the others share the rest.  Rounding leaves at most a
token for each node unspent.

A leaf's budget is taken from seeded epochs: whole ones first, then the prefix
of one more, in the order of a hash of seed, epoch and id.  The last document is
cut, so a leaf's tokens are exact.  Prefixes are found by sums over hash ranges,
then inside a range; no leaf is sorted as a whole.

Weights of nodes that are not listed are ``other`` (0 leaves them out).  Null
domain, language or source is the node ``unknown``; null and empty texts have no
tokens and are never chosen; repeated rows count each and are chosen in turn.
An empty table, or a budget of 0, chooses nothing.  Other columns pass through;
only columns named ``mix_...`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigloom.llm.shared import stored

LEVELS = ("mix_domain", "mix_lang", "mix_source")
#: Ranges of the order hash, as leading bits.
RANGE_BITS = 12
#: Leaves that are broadcast to the documents; more are joined by a shuffle.
MOST_LEAVES = 100_000
_WHOLE = "decimal(38,0)"


def default_domain(source: Column) -> Column:
    """Sources are grouped in four domains by the remainder of their number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string")))


def word_tokens(text: Column) -> Column:
    """Tokens of a text: its words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _nodes(docs: DataFrame) -> DataFrame:
    """``docs`` with the nodes and tokens of each row."""
    unknown = F.lit("unknown")
    return docs.withColumns(
        {
            "mix_domain": default_domain(F.col("source").cast("string")),
            "mix_lang": F.coalesce(F.col("lang").cast("string"), unknown),
            "mix_source": F.coalesce(F.col("source").cast("string"), unknown),
            "mix_tokens": word_tokens(F.col("text").cast("string")),
        }
    ).where("mix_tokens > 0")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], total: int, most_epochs: int, other: int = 1) -> DataFrame:
    """The leaves (LEVELS, tokens) with the budget of each.

    ``weights`` has whole numbers by level (domain, lang, source) and name.
    """
    rows = leaves.withColumn("capacity", (F.col("tokens") * most_epochs).cast(_WHOLE))
    weight = {}
    for level in LEVELS:
        weight[level] = F.lit(other)
        for name, w in sorted(weights.get(level.removeprefix("mix_"), {}).items()):
            weight[level] = F.when(F.col(level) == name, F.lit(w)).otherwise(weight[level])
        rows = rows.where(weight[level] > 0)  # what is left out has no capacity at any level
    given = None
    for depth, level in enumerate(LEVELS):
        above, here = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = rows.groupBy(*here).agg(F.sum("capacity").cast(_WHOLE).alias("capacity")).withColumn("weight", weight[level].cast(_WHOLE))
        nodes = nodes.join(given, above) if given is not None else nodes.withColumn("budget", F.lit(total).cast(_WHOLE))
        order = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        along = order.orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), level)
        before, rest = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.select(
            "*",
            (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).cast(_WHOLE).alias("left"),
            F.sum("weight").over(rest).cast(_WHOLE).alias("weights_left"),
        )
        full = F.col("capacity") * F.col("weights_left") <= F.col("left") * F.col("weight")
        # once a child is not full, none after it is: all share what is left there
        nodes = nodes.select("*", F.when(~full, F.struct("left", "weights_left")).alias("short"))
        stop = F.first("short", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        nodes = nodes.withColumn("stop", stop)
        part = F.floor(F.col("stop.left") * F.col("weight") / F.col("stop.weights_left")).cast(_WHOLE)
        given = nodes.select(*here, F.when(F.col("stop").isNull(), F.col("capacity")).otherwise(F.least(part, "capacity")).alias("budget"))
    return leaves.join(given, list(LEVELS), "left").select(*LEVELS, "tokens", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], total: int | float, most_epochs: int = 4, seed: int = 1, other: int = 1) -> DataFrame:
    """The chosen rows with mix_domain, mix_lang, mix_source, mix_tokens, mix_epochs and mix_extra.

    A document is taken ``mix_epochs`` times whole and then its first
    ``mix_extra`` tokens.  ``total``: tokens, or as a float a share of all.
    """
    rows = _nodes(docs)
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("mix_tokens").cast("long").alias("tokens")), "tokens")  # else every level reads all texts
    if isinstance(total, float):
        total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * total)
    given = budgets(leaves, weights, total, most_epochs, other).where("budget > 0")
    given = given.select(
        *LEVELS, F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("mix_epochs"), (F.col("budget") % F.col("tokens")).cast("long").alias("mix_rest")
    )
    # the order of the epoch that is not whole; documents of one id are told apart by their text
    document = ["mix_id", "mix_text"]
    rows = rows.withColumns({"mix_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mix_text": F.md5(F.col("text").cast("binary"))})
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "mix_epochs", *document).cast("binary")), 1, 15), 16, 10).cast("long")
    # a shuffle by leaf would do for what follows as well, and keep a hot leaf in one task: documents are dealt by leaf and range
    given = stored(given, "leaves")
    few = given.count() <= MOST_LEAVES
    placed = rows.join(F.broadcast(given) if few else given, list(LEVELS))
    placed = placed.withColumn("mix_place", place).withColumn("mix_range", F.shiftright("mix_place", 60 - RANGE_BITS))
    if not few:
        placed = placed.repartition(*LEVELS, "mix_range")
    ranges = placed.groupBy(*LEVELS, "mix_range").agg(F.sum("mix_tokens").alias("mix_sum"))
    lower = Window.partitionBy(*LEVELS).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*LEVELS, "mix_range", F.coalesce(F.sum("mix_sum").over(lower), F.lit(0)).alias("mix_before"))
    inside = Window.partitionBy(*LEVELS, "mix_range").orderBy("mix_place", *document).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("mix_before") + F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0))
    extra = F.least("mix_tokens", F.greatest(F.col("mix_rest") - F.col("mix_ahead"), F.lit(0))).cast("long")
    chosen = placed.join(ranges, [*LEVELS, "mix_range"]).withColumn("mix_ahead", ahead).withColumn("mix_extra", extra)
    new = ["mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_epochs", "mix_extra"]
    return chosen.where("mix_epochs > 0 OR mix_extra > 0").select(*[c for c in docs.columns if c not in new], *new)
