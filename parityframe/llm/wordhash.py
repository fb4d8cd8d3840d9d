"""Vectorised word hashes of Arrow text batches.

Python tasks of this subpackage get whole Arrow batches. The helpers below
work on the raw UTF-8 buffer of a batch, cut into slices of bounded size, so
no Python object per word is made and a task's memory does not depend on its
partition. A text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 19

#: Bytes that separate words when words are runs of non-space: [\x20\x09-\x0D].
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


class Lane(NamedTuple):
    """One hash function on bytes: a value per byte, and the odd base whose
    powers (and inverse powers) weight the places."""
    table: np.ndarray
    base: int
    inverse: int


def lane(seed: int, separators: tuple[int, ...], lower: bool) -> Lane:
    """Hash function number ``seed``; separators count as nothing, and with
    ``lower`` A-Z hash like a-z."""
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    base = int(rng.integers(1 << 40, 1 << 63)) | 1
    return Lane(table, base, pow(base, -1, 1 << 64))


#: Longer words are hashed by xxhash: modulo 2**64 a polynomial in any odd base
#: has long words (of some thousand letters) that are equal in every lane.
LONG_WORD = 32
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the life of the worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Words(NamedTuple):
    """The words of a slice of texts. ``starts``/``ends`` are byte places in
    ``data``; the words of text i are first[i]..first[i+1]."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Words are maximal runs of bytes with is_word[byte] inside one text."""
    n = len(data)
    inside = is_word[data]
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(words: Words, ln: Lane) -> np.ndarray:
    """64-bit hash of each word (uint64)."""
    n = len(words.data)
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(ln.table[words.data] * powers(ln.base, n), out=sums[1:])
    h = sums[words.ends] - sums[words.starts]
    h *= powers(ln.inverse, n)[words.starts]
    lengths = words.ends - words.starts
    h += lengths.astype(np.uint64)
    long = np.flatnonzero(lengths > LONG_WORD)
    if len(long):
        lower, seed = ln.table[65] == ln.table[97], ln.base >> 1
        for i in long:
            word = words.data[words.starts[i]:words.ends[i]].tobytes()
            h[i] = xxhash.xxh64_intdigest(word.translate(_LOWER) if lower else word, seed)
    return mix(h)


def gram_hashes(h: np.ndarray, k: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 places hold what
    reaches beyond the input and must not be used."""
    out = np.zeros(len(h), dtype=np.uint64)
    if len(h) < k:
        return out
    n = len(h) - k + 1
    for j in range(k):
        out[:n] *= np.uint64(base)
        out[:n] += h[j:j + n]
    return mix(out)


def room(first: np.ndarray, n: int) -> np.ndarray:
    """For each of n words, how many words its text has from it on."""
    counts = np.diff(first)
    return np.repeat(first[1:], counts) - np.arange(n)


def word_table(separators: tuple[int, ...]) -> np.ndarray:
    """is_word for find_words: every byte but the separators."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table
