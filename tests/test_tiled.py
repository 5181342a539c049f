import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from contigloom.operators import tiled as T


def _rows(spark, seed=1):
    rnd = random.Random(seed)
    rows = {(k, p) for k in range(3) for p in rnd.sample(range(200), 60)}
    return spark.createDataFrame([(k, p, rnd.randint(-5, 9), p + rnd.randint(0, 9)) for k, p in rows], "k long, p long, v long, e long")


def _set(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_prefix_in_tiles_equals_plain_window(spark, tiled):
    df = _rows(spark)
    got = T.exclusive_prefix(df, ["k"], "p", {"s": ("sum", "v"), "m": ("max", "v"), "n": ("min", "v")}, bits=3)
    w = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "p", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"), F.min("v").over(w).alias("n"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.select("k", "p", "s", "m", "n").collect()), key=key) == sorted((tuple(r) for r in want.collect()), key=key)


def test_islands_in_tiles(spark, tiled):
    df = _rows(spark, 2)
    got = {(r.k, r.p): r.i for r in T.island_starts(df, ["k"], "p", "e", "i", bits=3).collect()}
    for k in range(3):
        reach = start = None
        for p, e in sorted((r.p, r.e) for r in df.collect() if r.k == k):
            if reach is None or p > reach + 1:
                start = p
            reach = e if reach is None else max(reach, e)
            assert got[(k, p)] == start


def test_neighbours_and_numbers_in_tiles(spark, tiled):
    df = _rows(spark, 3)
    near = T.ordered_neighbours(df, ["k"], "p", [F.col("p")], ["p", "v"], bits=3)
    w = Window.partitionBy("k").orderBy("p")
    want = df.select("k", "p", F.lead("p").over(w).alias("a"), F.lag("v").over(w).alias("b"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in near.select("k", "p", "next_p", "prev_v").collect()), key=key) == sorted((tuple(r) for r in want.collect()), key=key)
    numbered = T.number_rows(df, "k", "p", [F.col("p")], "n", bits=3)
    assert [r.n for r in numbered.orderBy("k", "p").collect()] == list(range(df.count()))


def test_tile_rows_are_not_broadcast(spark, tiled):
    df = _rows(spark, 4)
    made = {
        "prefix": T.exclusive_prefix(df, ["k"], "p", {"s": ("sum", "v")}),
        "islands": T.island_starts(df, ["k"], "p", "e", "i"),
        "neighbours": T.ordered_neighbours(df, ["k"], "p", [F.col("p")], ["v"]),
        "numbers": T.number_rows(df, "k", "p", [F.col("p")], "n"),
    }
    for name, out in made.items():
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString(), name
