"""Small helpers of the text operators: stored tables, crc32 splits, fixed-size bitmaps."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contigloom.session import shared_folder


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` the files are columnar and compressed, and a reader
    takes only the columns it needs; like it, they outlive any executor.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is the fast way where a text is plain ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Bitmap:
    """Bloom filter of a fixed size over longs, built and tested as a table of words.

    Its size is a constant (2 ** bits / 8 bytes), whatever is put in, so it can
    go to every task.  It only thins what a following exact join has to move: a
    fuller bitmap lets more rows pass and never loses one.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def _probes(values: np.ndarray, bits: int) -> list[np.ndarray]:
        mixed = values.astype(np.int64, copy=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return [mixed >> np.uint64(64 - bits), (mixed >> np.uint64(3)) & np.uint64((1 << bits) - 1)]

    @classmethod
    def of(cls, df: DataFrame, column: str, bits: int = 26) -> Bitmap:
        """At most 2 ** bits / 64 (word, mask) rows reach the driver."""

        def words(batches):
            import pyarrow as pa

            for batch in batches:
                values = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                at = np.unique(np.concatenate(cls._probes(values, bits)))
                word, first = np.unique((at >> np.uint64(6)).astype(np.int64), return_index=True)
                mask = np.uint64(1) << (at & np.uint64(63))
                merged = np.bitwise_or.reduceat(mask, first) if len(first) else mask
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(merged.view(np.int64))], ["word", "mask"])

        found = df.select(F.col(column).cast("long")).mapInArrow(words, "word long, mask long")
        merged = found.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        full = np.zeros(1 << (bits - 6), dtype=np.uint64)
        full[merged.column("word").to_numpy()] = merged.column("mask").to_numpy().view(np.uint64)
        return cls(full, bits)

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), dtype=bool)
        for at in self._probes(values, self.bits):
            word = self.words[(at >> np.uint64(6)).astype(np.int64)]
            out &= (word >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out
