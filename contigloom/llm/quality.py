"""Compression classifier for text quality.

Two zstandard dictionaries are filled with labelled text, one with good and one
with bad.  A text is compressed in chunks with each, and the normalised
difference of the sizes says which it is closer to.  A logistic curve, fitted on
labelled texts that are in neither dictionary, turns it into a probability;
how well the text compresses by itself and how long it is calibrate the
difference, since repeated words or a short text shift it.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled texts of a
class, of at most ``SAMPLE_BYTES`` bytes each, the first ones by a hash of their
id.  Everything else runs over all rows.

An id with several labels counts as bad if one is; labels other than 0 and 1
and null ids are ignored.  Without labels of both classes every score is the
share of good labels (0.5 without any).  Null and empty texts are scored as
texts of length 0, repeated rows alike, other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000
SAMPLE_BYTES = 16 << 10
DICTIONARY = 512 << 10
PIECE = 300
CHUNK = 1000
LEVEL = 6


class _Sizes:
    """Compressed sizes of a text with the bad, the good and no dictionary."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by = []
        for data in dictionaries:
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=known, **plain))
        self.by.append(zstandard.ZstdCompressor(**plain))

    def features(self, text: bytes) -> tuple[float, float, float, float]:
        bad = good = own = 0
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK]
            b, g, o = (len(c.compress(part)) for c in self.by)
            bad, good, own = bad + b, good + g, own + o
        n = max(len(text), 1)
        nearer = (bad - good) / max(bad, good, 1)
        return nearer, float(np.log(max(own, 1) / n)), nearer * min(1.0, n / PIECE), float(np.log1p(len(text)))


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes] | None
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((features - self.centre) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _features(dictionaries):
    def run(batches):
        sizes = _Sizes(dictionaries)
        for batch in batches:
            rows = [sizes.features((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "features"])

    return run


def _filled(texts: list[bytes]) -> bytes:
    """Pieces of all texts in turn, until the dictionary is full."""
    out, at = bytearray(), 0
    while len(out) < DICTIONARY and any(len(t) > at for t in texts):
        for t in texts:
            out += t[at : at + PIECE]
            if len(out) >= DICTIONARY:
                break
        at += PIECE
    return bytes(out[:DICTIONARY])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, lightly held towards 0."""
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        hessian = (z * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, z.T @ (weight * (y - p)) - 1e-2 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    """``train`` says of a label's doc_id whether it may be learnt from."""
    labelled = (
        labels.where(train & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min("quality").alias("label"))
    )
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return Model(None, np.zeros(4), np.ones(4), np.array([np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20), 0, 0, 0, 0]))
    order = F.xxhash64("id")
    some = [labelled.where(F.col("label") == c).orderBy(order, "id").limit(SAMPLE) for c in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]).withColumn("dictionary", F.pmod(F.shiftright(order, 8), F.lit(2)) == 0))  # 2 * SAMPLE rows at most
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        .where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(chosen, "id")
        .groupBy("id", "label", "dictionary")
        .agg(F.min("text").alias("text"))  # of rows that share an id, one
    ).cache()
    known = texts.where("dictionary").orderBy(F.xxhash64("id"), "id").select("label", "text").collect()
    dictionaries = tuple(_filled([r.text.encode() for r in known if r.label == c]) for c in (0, 1))
    rest = texts.where("NOT dictionary").select("label", "text").mapInArrow(_features(dictionaries), "label int, features array<double>").toArrow()
    texts.unpersist()
    y = rest.column("label").to_numpy().astype(float)
    x = np.array(rest.column("features").to_pylist(), dtype=float).reshape(-1, 4)
    centre, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(4), np.ones(4))
    own = np.array([max((y == c).sum(), 1) for c in (0, 1)])
    weight = np.array([counts[0], counts[1]])[y.astype(int)] / own[y.astype(int)]  # the sample has as many of each class
    weight = weight * len(y) / max(weight.sum(), 1e-9)
    return Model(dictionaries, centre, scale, _logistic((x - centre) / scale, y, weight))


def _scored(model: Model, carry: list[int]):
    """The columns to carry come first, the text last."""

    def run(batches):
        sizes = _Sizes(model.dictionaries) if model.dictionaries else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 512):
                rows = [sizes.features((t or "").encode()) if sizes else (0.0,) * 4 for t in texts.slice(at, 512).to_pylist()]
                scores = pa.array(model.score(np.array(rows, float).reshape(-1, 4)))
                kept = [batch.column(i).slice(at, 512) for i in carry]
                yield pa.RecordBatch.from_arrays([*kept, scores], [*[batch.schema.names[i] for i in carry], "_score"])

    return run


def scores(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all) of ``docs`` with ``_score``, the probability of a good label by the text alone."""
    carry = [c for c in docs.columns if c != "_score"] if carry is None else carry
    text = F.col("text").cast("string")
    # a carried text is sent once: it stands last and is taken from there
    order = [c for c in carry if c != "text"]
    rows = docs.select(*order, text.alias("text"))
    sent = list(range(len(order))) + ([len(order)] if "text" in carry else [])
    fields = [rows.schema[i] for i in sent]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    scored = rows.mapInArrow(_scored(model, sent), f"{schema}, `_score` double")
    return scored.select(*carry, "_score")
