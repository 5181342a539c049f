"""MinHash near-duplicates by a multi-index Hamming join.

A text's set is its distinct ``words``-word shingles.  Two texts are linked when
``100 * |A & B| >= similarity * |A | B|``, which is always confirmed on the full
sets.  Candidates come from signatures of 48 MinHash values of 16 bits:

* A pair at the threshold 0.8 differs in at most 23 of 48 values but for about
  3 cases in a million (binomial tail), so the signature-distance threshold is 23.
* The signature is split into 12 chunks of 4 values.  At most 23 differences
  over 12 chunks leave a chunk with at most one (pigeonhole: 12 * 2 > 23).
* Each chunk is indexed under its 4 enumerated single errors (one value left
  out), so every pair within the threshold shares a key: 48 keys a text.

No bucket is expanded into all its pairs.  First every member of a bucket is
compared with the smallest one (a star), the confirmed links give components,
and only buckets that still hold several components are looked at once more: in
blocks of bounded size, the members outside the largest component are held
against all others, and only confirmed links that join components leave the
task.  Texts of equal sets are one class from the start, so exact copies never
meet.

Rows: repeated rows give repeated rows.  Null or empty texts have an empty set,
are linked with nothing, and are their own component.  A null id takes no part:
its row comes back with a null component, kept.  Of several different texts
under one id, each is a class under that id.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigloom.llm import words as W
from contigloom.llm.shared import Bitmap, stored
from contigloom.operators.components import connected_components
from contigloom.session import cut_lineage

_U = np.uint64
SLOTS, CHUNK = 48, 4
#: Shingles of a bucket block; two blocks at most are held against each other at a time.
BLOCK = 1 << 20
#: Members a leader's set meets in one task.
STAR = 500

_SLOT_A, _SLOT_B = W.constants(SLOTS, 5), W.constants(SLOTS, 6)


def _signature(shingles: np.ndarray) -> bytes:
    low = None
    for at in range(0, len(shingles), 2048):
        part = (shingles[at : at + 2048, None] * _SLOT_A + _SLOT_B).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return (W.mix(low) >> _U(48)).astype(np.uint16).tobytes()


def _class_id(shingles: np.ndarray) -> bytes:
    """128-bit fingerprint of a set: two sums of independent mixes."""
    return np.array([W.mix(shingles).sum(), W.mix(shingles ^ _U(0x5851F42D4C957F2D)).sum()], dtype=_U).tobytes()


def _sketches(width: int):
    places = W.constants(width, 3)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, offsets, hashes in W.hash_words(batch.column(1), W.SPACED):
                sizes, classes, signatures = [], [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    s = W.shingle_set(hashes[a:b], places)
                    sizes.append(len(s))
                    classes.append(_class_id(s) if len(s) else None)
                    signatures.append(_signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
                    ["doc_id", "n_shingles", "cls", "sig"],
                )

    return run


def sketch(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, cls, sig) of every row; cls and sig are null for empty sets."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sketches(words), "doc_id long, n_shingles long, cls binary, sig binary"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a batch as one row of values each."""
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]] if len(column) else np.empty(0, np.uint8)
    return raw.view(np.uint16).reshape(-1, SLOTS)


def _keys(batches):
    """Every chunk under each of its enumerated single errors."""
    for batch in batches:
        ids = batch.column("rep").to_numpy()
        sizes = batch.column("n_shingles").to_numpy()
        for at in range(0, len(ids), 4096):
            values = _matrix(batch.column("sig").slice(at, 4096)).astype(np.int64)
            out = []
            for chunk in range(SLOTS // CHUNK):
                for left_out in range(CHUNK):
                    a, b, c = (values[:, chunk * CHUNK + j] for j in range(CHUNK) if j != left_out)
                    out.append((chunk * CHUNK + left_out) << 48 | a << 32 | b << 16 | c)
            keys = np.stack(out, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(ids[at : at + 4096], SLOTS)), pa.array(np.repeat(sizes[at : at + 4096], SLOTS))],
                ["key", "id", "n"],
            )


def _packed_sets(width: int, wanted: Bitmap):
    """Sets of the rows whose id the bitmap holds: 6 bytes of every shingle, sorted."""
    places = W.constants(width, 3)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            there = np.flatnonzero(wanted.holds(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False))
            batch = batch.take(pa.array(there))
            for lo, hi, offsets, hashes in W.hash_words(batch.column(1), W.SPACED):
                classes, sets = [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    s = W.shingle_set(hashes[a:b], places)
                    classes.append(_class_id(s) if len(s) else None)
                    short = np.sort(s & _U((1 << 48) - 1))
                    sets.append(short.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "cls", "set"]
                )

    return run


def _unpacked(packed: bytes) -> np.ndarray:
    full = np.zeros((len(packed) // 6, 8), np.uint8)
    full[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return full.view(_U).ravel()


def _compare(similarity: int):
    """Rows sorted by (a, salt, role): a leader's set, then the members to hold against it."""

    def run(batches):
        leader, lead = None, None
        for batch in batches:
            left, right = [], []
            for a, role, b, packed in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "b", "set"))):
                if role == 0:
                    leader, lead = a, _unpacked(packed)
                elif a == leader:
                    other = _unpacked(packed)
                    both = len(np.intersect1d(lead, other, assume_unique=True))
                    if 100 * both >= similarity * (len(lead) + len(other) - both):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return run


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, cls, set) of the ids asked for (column id), and perhaps of a few others."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_packed_sets(words, Bitmap.of(ids, "id")), "doc_id long, cls binary, set binary")


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of class ids that the full sets link, as (u, v).

    A leader's set is sent once for each STAR of its members, so a leader of
    many members is spread over tasks.
    """
    # stored, as are the other counts here that are joined back: a join of two own exchanges is one whose hot keys Spark can split
    fans = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("fans")), "fans")
    members = pairs.join(fans, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("salt"), F.lit(1).alias("role"), "b"
    )
    leaders = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"))
    to = members.unionByName(leaders).join(classes.select(F.col("rep").alias("b"), F.col("cls").alias("want")), "b")
    sets = _sets(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), words)
    rows = sets.join(to, (F.col("doc_id") == F.col("b")) & (F.col("cls") == F.col("want"))).select("a", "salt", "role", "b", "set")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return dealt.mapInArrow(_compare(similarity), "u long, v long")


def _joining(rows: list[tuple], similarity: int) -> list[tuple[int, int]]:
    """Confirmed links between components among the members of one or two blocks of a bucket.

    ``rows`` are (key, mine, other, home, id, component, set).
    """
    ids, comps, homes = (np.array([r[i] for r in rows]) for i in (4, 5, 3))
    sets = [_unpacked(r[6]) for r in rows]
    sizes = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    shingles, number = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(shingles), np.int32)
    _, label = np.unique(comps, return_inverse=True)
    one_block = rows[0][1] == rows[0][2]
    links = []
    for i in np.flatnonzero(label != np.bincount(label).argmax()):
        other = label != label[i]
        if not one_block:  # pairs of the same block meet in the part of that block alone
            other &= homes != homes[i]
        if not other.any():
            continue
        own = number[begin[i] : begin[i] + sizes[i]]
        marked[own] = 1
        both = np.add.reduceat(marked[number], begin)
        marked[own] = 0
        linked = np.flatnonzero(other & (100 * both >= similarity * (sizes + sizes[i] - both)))
        for j in linked:
            if label[j] != label[i]:
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return links


def _close_links(similarity: int):
    """Rows sorted by (key, mine, other), a part of a bucket at a time."""

    def run(batches):
        held, at = [], None

        def out():
            links = _joining(held, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["u", "v"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "mine", "other", "home", "id", "component", "set"))):
                if row[:3] != at and held:
                    yield out()
                    held = []
                at = row[:3]
                held.append(row)
        if held:
            yield out()

    return run


def _rest(docs: DataFrame, buckets: DataFrame, components: DataFrame, classes: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links (u, v) across components in buckets of three and more that still hold several."""
    labelled = buckets.join(components, buckets.id == components.vertex, "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("component")
    )
    mixed = stored(
        labelled.groupBy("key")
        .agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi AND size >= 3")
        .select("key", F.ceil(F.col("shingles") / F.lit(BLOCK)).cast("int").alias("blocks")),
        "mixed",
    )
    members = stored(labelled.join(mixed, "key"), "members")
    rows = (
        members.withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "id", "component", "home", F.least("home", "with").alias("mine"), F.greatest("home", "with").alias("other"))
        .join(classes.select(F.col("rep").alias("id"), F.col("cls").alias("want")), "id")
    )
    sets = _sets(docs, members.select("id"), words)
    parts = ["key", "mine", "other"]
    sent = sets.join(rows, (F.col("doc_id") == F.col("id")) & (F.col("cls") == F.col("want"))).select(*parts, "home", "id", "component", "set")
    return sent.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(_close_links(similarity), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sketches = stored(sketch(docs, words), "sketches")
    # a class under each id where it stands: the smallest stands for all
    classes = stored(
        sketches.where("cls IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")),
        "classes",
    )
    keyed = classes.mapInArrow(_keys, "key long, id long, n long")
    shared = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.count("*").alias("size")).where("size > 1")
    shared = stored(shared.select("key", F.col("first.id").alias("leader"), F.col("first.n").alias("leader_n")), "shared")
    buckets = stored(keyed.join(shared, "key"), "buckets")
    allowed = 100 * F.least("n", "leader_n") >= similarity * F.greatest("n", "leader_n")
    stars = cut_lineage(buckets.where((F.col("id") != F.col("leader")) & allowed).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    links = cut_lineage(confirm(docs, classes, stars, words, similarity))
    components = connected_components(links)
    more = cut_lineage(_rest(docs, buckets, components, classes, words, similarity))
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))
    named = classes.join(components, classes.rep == components.vertex, "left").select("cls", F.coalesce("component", "rep").alias("found"))
    rows = sketches.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("found"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).select(
        "*", (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept")
    )
