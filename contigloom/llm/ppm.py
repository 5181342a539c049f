"""Document scores by prediction by partial matching (PPM) over bytes, beside an add-one word model.

The trie of byte contexts up to ``order`` symbols is a table of counts by gram
(context and symbol), A-Z lower-cased; a text is padded at its start and closed
by an end symbol, both the byte 0xFF that no text holds.  Because every text is
padded, the counts of shorter contexts are sums over the longest ones.

The probability of a symbol follows method C: with T counted and D distinct
symbols in a context, a seen symbol has c / (T + D) and an escape D / (T + D).
After an escape the symbols of the longer context are excluded from the shorter
one's c, T and D; below order 0 the symbols left are equally likely.  Symbols
seen in a context are all seen in its suffixes, so an exclusion is a
subtraction of sums, and the code length of a gram depends on that gram alone.
So a model of any size is applied by joins:

1. each task packs its texts in blocks and writes the blocks with the distinct
   grams and words of each and how often training texts hold them,
2. the counts are added up over blocks, and grams get their log probability,
3. every block gets back the values of its own grams and words, and adds up
   its documents.

Nothing but two bounded things goes through the driver: totals, and the 256 x
256 counts of orders 1 and 0.  Words are told apart by 64-bit hashes.

Null texts count as empty; an empty text is its end symbol.  A null id is
hashed as empty text for the training split.  Repeated rows are scored (and
trained on) once each.  Without any training text every symbol is equally
likely and the word model knows nothing.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contigloom.llm import words as W
from contigloom.llm.shared import stored

_U = np.uint64
ORDER = 5
#: Bytes of text in a block; one text alone may be larger.
BLOCK = 32 << 20
#: Bytes of text whose grams are held at a time; a single text may be longer.
GRAM_SLICE = 1 << 19
_WORD, _GRAM, _TEXT = 0, 1, 2
#: Key of the end token among word hashes.
END = 0
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, words double, score double, n_bytes long"


def _grams(texts: pa.Array, order: int):
    """(first row, end row, symbols of each row, gram codes) by slices; the last symbol is in the low byte."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + GRAM_SLICE, side="right")) - 1)
        sizes = np.diff(ends[row : end + 1])
        own = np.repeat(np.arange(end - row), sizes)
        padded = np.full(int(sizes.sum()) + (order + 1) * (end - row), 0xFF, np.uint8)
        at = np.arange(len(own)) + own * (order + 1) + order
        padded[at] = W.LOWER[raw[ends[row] : ends[end]]]
        code = padded.astype(_U)
        for j in range(1, order + 1):
            code[j:] |= padded[:-j].astype(_U) << _U(8 * j)
        real = np.ones(len(padded), bool)
        begin = np.concatenate([[0], np.cumsum(sizes[:-1] + order + 1)])
        for j in range(order):
            real[begin + j] = False
        yield row, end, sizes + 1, code[real]
        row = end


def _totals(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums.  The parts are sorted runs, which a stable sort merges."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[by], first).astype(np.int64)


def _add(parts: list[tuple[np.ndarray, np.ndarray]], part: tuple[np.ndarray, np.ndarray]) -> None:
    """Append to parts of which each is more than twice the next, so that they hold few keys more than once."""
    while parts and len(parts[-1][0]) <= 2 * len(part[0]):
        part = _totals([parts.pop(), part])
    parts.append(part)


def _counted(codes: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how many of each stand in training texts."""
    keys, inverse = np.unique(codes, return_inverse=True)
    return keys, np.bincount(inverse, trained, len(keys))


def _pack(order: int):
    """Per block: a row with its texts, and rows with its distinct words and grams."""

    def rows(block, kind, keys, counts, text=None):
        n = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), pa.array(np.full(n, kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts), pa.array([text] * n, pa.binary())],
            ["block", "kind", "key", "n", "texts"],
        )

    def finish(number, held):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        trained = ~batch.column(1).to_numpy(zero_copy_only=False)
        words, grams = [(np.array([END], _U), np.array([trained.sum()], np.float64))], []
        for lo, hi, offsets, hashes in W.hash_words(batch.column(2), W.SPACED):
            _add(words, _counted(hashes, np.repeat(trained[lo:hi], np.diff(offsets)).astype(np.float64)))
        for lo, hi, sizes, codes in _grams(batch.column(2), order):
            _add(grams, _counted(codes, np.repeat(trained[lo:hi], sizes).astype(np.float64)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        yield rows(number, _TEXT, np.zeros(1, _U), np.zeros(1, np.int64), sink.getvalue().to_pybytes())
        for kind, parts in ((_WORD, words), (_GRAM, grams)):
            keys, counts = _totals(parts)
            for at in range(0, len(keys), 1 << 16):
                yield rows(number, kind, keys[at : at + (1 << 16)], counts[at : at + (1 << 16)])

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = int(pa.compute.sum(pa.compute.binary_length(part.column(2))).as_py() or 0)
                if held and size + own > BLOCK:
                    yield from finish(number, held)
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += own
        if held:
            yield from finish(number, held)

    return run


def gram_log10(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of the last symbol of each gram.

    ``keys`` (sorted, distinct) must hold all grams of their two last context
    bytes; ``pairs`` are the counts of all (context byte, symbol).
    """
    pairs = pairs.astype(np.float64)
    symbol, byte = (keys & _U(255)).astype(np.int64), ((keys >> _U(8)) & _U(255)).astype(np.int64)
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    longer = None  # (suffix keys, counts, context of each, distinct per context, row of each gram)
    for k in range(order, -1, -1):
        if k >= 2:
            suffix, row = np.unique(keys & _U((1 << (8 * k + 8)) - 1), return_inverse=True)
            c = np.bincount(row, counts, len(suffix))
            _, context = np.unique(suffix >> _U(8), return_inverse=True)
            total = np.bincount(context, c)
            distinct = np.bincount(context, c > 0)
            own_c, own_t, own_d = c[row], total[context[row]], distinct[context[row]]
        else:
            table = pairs if k else np.broadcast_to(pairs.sum(axis=0), pairs.shape)
            own_c, own_t, own_d = table[byte, symbol], table.sum(axis=1)[byte], (table > 0).sum(axis=1)[byte]
        if k < order:  # exclude what the longer context has seen
            if k + 1 >= 2:
                l_suffix, l_c, l_context, l_distinct, l_row = longer
                if k >= 2:
                    short = c[np.searchsorted(suffix, l_suffix & _U((1 << (8 * k + 8)) - 1))]
                else:
                    short = table[((l_suffix >> _U(8)) & _U(255)).astype(np.int64), (l_suffix & _U(255)).astype(np.int64)]
                gone = np.bincount(l_context, short * (l_c > 0))[l_context[l_row]]
                gone_d = l_distinct[l_context[l_row]]
            else:
                gone = ((pairs > 0) * table).sum(axis=1)[byte]
                gone_d = (pairs > 0).sum(axis=1)[byte]
            own_t, own_d = own_t - gone, own_d - gone_d
        hit = open_ & (own_c > 0)
        out[hit] += np.log10(own_c[hit] / (own_t[hit] + own_d[hit]))
        open_ &= ~hit
        escape = open_ & (own_d > 0)
        out[escape] += np.log10(own_d[escape] / (own_t[escape] + own_d[escape]))
        longer = (suffix, c, context, distinct, row) if k >= 2 else None
    left = 256 - int((pairs.sum(axis=0) > 0).sum())
    out[open_] -= math.log10(max(left, 1))
    return out


def _scored_grams(pairs: np.ndarray, order: int):
    """A partition's grams (all of a two-byte context together) with their log10 probability."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            keys, counts = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "n"))
            by = np.argsort(keys.view(_U))
            value = gram_log10(keys.view(_U)[by], counts[by].astype(np.float64), pairs, order)
            for at in range(0, len(by), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[by][at : at + (1 << 16)]), pa.array(value[at : at + (1 << 16)])], ["key", "value"])

    return run


def _scores(order: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, keys, value = (right.column(c).to_numpy() for c in ("kind", "key", "value"))
        tables = {}
        for k in (_WORD, _GRAM):
            own = keys[kind == k].view(_U)
            by = np.argsort(own)
            tables[k] = own[by], value[kind == k][by]
        words, count = tables[_WORD]
        end_count = count[np.searchsorted(words, _U(END))] if len(words) else 0.0
        out = []
        for packed in left.column("texts"):
            batch = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
            rows = batch.num_rows
            n, known, base, score, size = (np.zeros(rows) for _ in range(5))
            for lo, hi, offsets, hashes in W.hash_words(batch.column(2), W.SPACED):
                c = count[np.searchsorted(words, hashes)]
                own = np.repeat(np.arange(hi - lo), np.diff(offsets))
                n[lo:hi] = np.diff(offsets) + 1
                known[lo:hi] = np.bincount(own, c > 0, hi - lo) + (end_count > 0)
                base[lo:hi] = np.bincount(own, np.log10(c + 1), hi - lo) + math.log10(end_count + 1)
            grams, logs = tables[_GRAM]
            for lo, hi, sizes, codes in _grams(batch.column(2), order):
                own = np.repeat(np.arange(hi - lo), sizes)
                score[lo:hi] = np.bincount(own, logs[np.searchsorted(grams, codes)], hi - lo)
                size[lo:hi] = sizes - 1
            as_long = lambda x: pa.array(x.astype(np.int64))
            out.append(
                pa.table(
                    [batch.column(0), batch.column(1), as_long(n), as_long(known), pa.array(base), pa.array(score), as_long(size)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "words", "score", "n_bytes"],
                )
            )
        return pa.concat_tables(out)

    return run


def ppm_scores(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    The model is trained on the rows where ``held_out`` is false and fixed
    while it scores.  ``score`` is the log10 probability of the text under PPM,
    ``base_score`` under add-one word counts.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7: a gram is packed in a long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    packed = stored(rows.mapInArrow(_pack(order), "block long, kind int, key long, n long, texts binary"), "blocks", "zstd")
    words = packed.where(F.col("kind") == _WORD).select("block", "key", "n")
    grams = packed.where(F.col("kind") == _GRAM).select("block", "key", "n")
    # a word stands once in a block, so a window over a word has a row for each block at most
    same = Window.partitionBy("key")
    replies = stored(
        words.select("block", "key", F.sum("n").over(same).alias("total"), (F.row_number().over(same.orderBy("block")) == 1).alias("first")), "words", "zstd"
    )
    once = F.when(F.col("first") & (F.col("total") > 0), F.col("total"))
    total = replies.agg(F.coalesce(F.sum(once), F.lit(0)), F.count(once)).first()
    gram_counts = stored(grams.groupBy("key").agg(F.sum("n").alias("n")), "grams", "zstd")
    pairs = np.zeros(65536)
    low = gram_counts.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).toArrow()  # at most 65,536 rows
    pairs[low.column("pair").to_numpy()] = low.column("n").to_numpy()
    logs = gram_counts.repartition(F.shiftright("key", 8).bitwiseAND(0xFFFF)).mapInArrow(_scored_grams(pairs.reshape(256, 256), order), "key long, value double")
    values = replies.select("block", F.lit(_WORD).alias("kind"), "key", F.col("total").cast("double").alias("value"))
    values = values.unionByName(grams.join(logs, "key").select("block", F.lit(_GRAM).alias("kind"), "key", "value"))
    texts = packed.where(F.col("kind") == _TEXT).select(F.col("block").alias("home"), "texts")
    scored = texts.groupBy("home").cogroup(values.groupBy("block")).applyInArrow(_scores(order), _OUT)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total[0]).cast("long").alias("train_tokens"),
        (F.col("words") - F.col("n_tokens") * math.log10(total[0] + total[1] + 1)).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _adaptive(text: bytes, order: int) -> float:
    """log10 probability of one text by a trie that starts empty and learns as it reads."""
    trie: dict[bytes, dict[int, int]] = {}
    data, total = b"\xff" * order + text + b"\xff", 0.0
    for i in range(order, len(data)):
        symbol, excluded = data[i], ()
        for k in range(order, -2, -1):
            if k < 0:
                total -= math.log10(256 - len(excluded))
                break
            seen = trie.get(data[i - k : i])
            if not seen:
                continue
            t, d = 0, 0
            for s, c in seen.items():
                if s not in excluded:
                    t, d = t + c, d + 1
            if symbol in seen:
                total += math.log10(seen[symbol] / (t + d))
                break
            if d:
                total += math.log10(d / (t + d))
            excluded = seen.keys()
        for k in range(order + 1):
            seen = trie.setdefault(data[i - k : i], {})
            seen[symbol] = seen.get(symbol, 0) + 1
    return total


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, score): each text under a model that has seen only its own beginning."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = [_adaptive((t or "").encode().lower(), order) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
