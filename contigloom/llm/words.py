"""Words of whole Arrow text columns as 64-bit hashes, by numpy and without a Python loop over words.

A byte is part of a word or not by a table of 256 entries; A-Z is lower-cased.
A word's hash is a sum of (byte value x position multiplier) with a final mix,
so it does not depend on where the word stands.  Multipliers come from a table
for a place in a block of 4,096 bytes, times one for the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
SLICE = 1 << 20  # bytes of text handled at a time


def _class(outside: list[tuple[int, int]]) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    for lo, hi in outside:
        inside[lo : hi + 1] = False
    return inside


#: Everything but ASCII white space.
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
#: Letters, digits and all beyond ASCII.
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BYTE = constants(256, 1)
_PLACE = constants(4096, 2)


def _multipliers(place: np.ndarray) -> np.ndarray:
    """One for every place in a word; the first block takes the table as it is."""
    out = _PLACE[place & 4095]
    late = np.flatnonzero(place >= 4096)
    if len(late):
        out[late] *= mix(((place[late] >> 12).astype(_U) + _U(3 << 40)) * _U(0x9E3779B97F4A7C15)) | _U(1)
    return out


def _hash_piece(raw: np.ndarray, breaks: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset of each word, hash); ``breaks`` are offsets where a text begins."""
    low = LOWER[raw]
    inside = word[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] = inside[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, _U)
    kept = low[inside]
    begins = (np.cumsum(inside) - 1)[starts]  # of each word among the kept bytes
    place = np.arange(len(kept)) - np.repeat(begins, np.diff(np.append(begins, len(kept))))
    sums = np.add.reduceat(_BYTE[kept] * _multipliers(place), begins)
    return starts, mix(sums)


def hash_words(texts: pa.Array, word: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word offsets of these rows, hashes), slice by slice.

    A null text has no words.  A text above SLICE is cut between words.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE, side="right")) - 1)
        lo, hi = int(ends[row]), int(ends[end])
        at, found, hashes = lo, [], []
        while at < hi:
            stop = hi
            if hi - at > 2 * SLICE:  # one long text: cut it at a byte outside words
                gaps = np.flatnonzero(~word[raw[at + SLICE : at + 2 * SLICE]])
                stop = at + SLICE + int(gaps[0]) if len(gaps) else hi
            own = ends[row:end]
            breaks = np.append(own[(own >= at) & (own < stop)], at) - at
            starts, got = _hash_piece(raw[at:stop], breaks, word)
            found.append(starts + at)
            hashes.append(got)
            at = stop
        starts = np.concatenate(found) if found else np.empty(0, np.int64)
        yield row, end, np.searchsorted(starts, ends[row : end + 1]), np.concatenate(hashes) if hashes else np.empty(0, _U)
        row = end


def windows(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Hash of the words ``i .. i + k - 1`` for every i, with one multiplier a place (0: place ignored)."""
    k = len(multipliers)
    if len(hashes) < k:
        return np.empty(0, _U)
    total = np.zeros(len(hashes) - k + 1, _U)
    for j, m in enumerate(multipliers):
        if m:
            total += hashes[j : len(hashes) - k + 1 + j] * m
    return mix(total)


def shingle_set(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of one text; fewer words than the shingle make one, none make none."""
    if not len(hashes):
        return hashes
    if len(hashes) < len(multipliers):
        return mix(np.array([(hashes * multipliers[: len(hashes)]).sum() + _U(len(hashes))], dtype=_U))
    return np.unique(windows(hashes, multipliers))
