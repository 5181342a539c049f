"""Index tables of a position-sorted BAM, from its records, and their file form."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigloom.functions.intervals import minimum_bin
from contigloom.operators.tiled import island_starts, ordered_neighbours
from contigloom.session import cut_lineage
from contigloom.sources.bam import INDEX_MAGIC, LINEAR_BITS, open_output


def bin_index(records: DataFrame) -> DataFrame:
    """(path, ref_id, bin, first, n): where the records of each bin begin."""
    placed = records.where("ref_id >= 0 AND pos >= 0").withColumn("bin", minimum_bin(F.col("pos"), F.col("epos")))
    return placed.groupBy("path", "ref_id", "bin").agg(F.min("rec_no").alias("first"), F.max("rec_no").alias("last"), F.count("*").alias("n"))


def linear_index(records: DataFrame) -> DataFrame:
    """(path, ref_id, window, first): first record overlapping each 16 kb window."""
    placed = records.where("ref_id >= 0 AND pos >= 0")
    windows = F.sequence(F.shiftright("pos", LINEAR_BITS), F.shiftright(F.greatest(F.col("epos") - 1, F.col("pos")), LINEAR_BITS))
    return placed.select("path", "ref_id", "rec_no", F.explode(windows).alias("window")).groupBy("path", "ref_id", "window").agg(
        F.min("rec_no").alias("first")
    )


def unsorted_records(records: DataFrame) -> DataFrame:
    """(path, n) of files whose records step back; an index of those would be wrong.

    Records of one file are compared through the highest place seen in each
    stretch of the file, so no file is sorted in one task.
    """
    from contigloom.operators.tiled import exclusive_prefix

    place = F.when(F.col("ref_id") < 0, F.lit(2**62)).otherwise(
        F.col("ref_id").cast("long") * (2**32) + F.col("pos")
    )
    rows = records.select("path", "rec_no", place.alias("place"))
    seen = exclusive_prefix(rows, ["path"], "rec_no", {"before": ("max", "place")}, bits=32)
    return seen.where("place < before").groupBy("path").agg(F.count("*").alias("n"))


def bin_chunks(records: DataFrame) -> DataFrame:
    """(path, ref_id, bin, begin, end): stretches of a file between virtual offsets that hold the records of a bin.

    Stretches become one where they touch or where only one block lies between.
    """
    file = records.select("path", "rec_no", "ref_id", "pos", "epos")
    after = ordered_neighbours(file, ["path"], "rec_no", [F.col("rec_no")], ["rec_no"], bits=32)
    # the last record of a file ends before any block that could follow it
    end = F.coalesce("next_rec_no", F.shiftleft(F.shiftright("rec_no", 16) + (1 << 16), 16))
    placed = after.where("ref_id >= 0 AND pos >= 0").select(
        "path", "ref_id", minimum_bin(F.col("pos"), F.col("epos")).alias("bin"), "rec_no", end.alias("end")
    )
    keys = ["path", "ref_id", "bin"]
    reach = placed.select(*keys, "rec_no", "end", (F.col("end") - 1).bitwiseOR(0xFFFF).alias("reach"))
    runs = island_starts(reach, keys, "rec_no", "reach", "begin", bits=32)
    return runs.groupBy(*keys, "begin").agg(F.max("end").alias("end"))


def index_files(records: DataFrame, references: DataFrame) -> DataFrame:
    """Write the whole index of every file of ``records`` next to it."""
    records = cut_lineage(records.select("path", "rec_no", "ref_id", "pos", "epos"))
    return write_bai(linear_index(records), references, bin_chunks(records))


def write_bai(linear: DataFrame, references: DataFrame, chunks: DataFrame) -> DataFrame:
    """Write the chunks of the bins and the linear index of every file next to it, as ``<path>.bai``; (path, windows) of each.

    ``references`` is (path, n).  A file's rows come sorted to one task, which
    writes them as they come, to the file system that holds the file.
    """
    chunks = cut_lineage(chunks)
    of_bin = chunks.groupBy("path", "ref_id", "bin").agg(F.count("*").alias("n"))
    n_bins = of_bin.groupBy("path", "ref_id").agg(F.count("*").alias("n"))
    n_windows = linear.groupBy("path", "ref_id").agg((F.max("window") + 1).alias("begin"))
    none, long = F.lit(-1).cast("long"), lambda c: F.col(c).cast("long")

    def rows(df: DataFrame, section: int, number, begin, end, n) -> DataFrame:
        columns = {"number": number, "begin": begin, "end": end, "n": n}
        return df.select("path", "ref_id", F.lit(section).alias("section"), *[c.cast("long").alias(k) for k, c in columns.items()])

    whole = rows(references.withColumn("ref_id", F.lit(-1)), 0, none, none, none, long("n"))
    heads = rows(n_bins.join(n_windows, ["path", "ref_id"]), 0, none, long("begin"), none, long("n"))
    bins = rows(chunks.join(of_bin, ["path", "ref_id", "bin"]), 1, long("bin"), long("begin"), long("end"), long("n"))
    windows = rows(linear, 2, long("window"), long("first"), none, none)
    every = whole.unionByName(heads).unionByName(bins).unionByName(windows)
    order = ["path", "ref_id", "section", "number", "begin"]
    return every.repartition("path").sortWithinPartitions(*order).mapInArrow(_written, "path string, windows long")


def _written(batches):
    empty = struct.pack("<ii", 0, 0)
    out, path, left, expected, total = None, None, 0, 0, 0
    last_bin = next_window = n_windows = None

    def close():
        out.write(empty * left)
        out.close()
        return pa.RecordBatch.from_pylist([{"path": path, "windows": total}])

    names = ("path", "ref_id", "section", "number", "begin", "end", "n")
    for batch in batches:
        for own, ref, section, number, begin, end, n in zip(*(batch.column(c).to_pylist() for c in names)):
            if own != path:
                if out is not None:
                    yield close()
                out, path, left, expected, total = open_output(own + ".bai"), own, n, 0, 0
                out.write(INDEX_MAGIC + struct.pack("<i", n))
            elif section == 0:  # a reference begins: those without records before it are empty
                out.write(empty * (ref - expected) + struct.pack("<i", n))
                left -= ref - expected + 1
                expected, last_bin, next_window, n_windows = ref + 1, None, None, begin
            elif section == 1:
                if number != last_bin:
                    out.write(struct.pack("<Ii", number, n))
                    last_bin = number
                out.write(struct.pack("<QQ", begin, end))
            else:
                if next_window is None:
                    out.write(struct.pack("<i", n_windows))
                    next_window = 0
                out.write(struct.pack("<Q", 0) * (number - next_window) + struct.pack("<Q", begin))
                next_window, total = number + 1, total + 1
    if out is not None:
        yield close()
