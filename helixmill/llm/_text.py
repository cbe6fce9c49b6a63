"""Words of Arrow text columns as numpy arrays, for operators that run inside mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at once; a longer document makes a piece of its own.
PIECE_BYTES = 2 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are taken in by eights, one after another; longer words go through a tree of them.
NEAR_BYTES = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass(frozen=True)
class Alphabet:
    codes: np.ndarray  # what a byte is read as
    gap: np.ndarray  # whether a byte lies between words


def alphabet(separators: list[int], lower: bool) -> Alphabet:
    codes, gap = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    if lower:
        codes[65:91] += 32
    gap[separators] = True
    return Alphabet(codes, gap)


SPACES = [*range(0x09, 0x0E), 0x20]
PLAIN = alphabet(SPACES, False)
LOWERED = alphabet(SPACES, True)
#: Letters, digits and all that is not ASCII; upper case is read as lower case.
ALNUM = alphabet([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], True)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order."""
    return mix(a * _R + b)


def range_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each slice values[first:end], wherever it lies: of its first and its last 2**k values, for the largest
    such power that it holds. Powers are combined pair by pair, as in a tree."""
    size = end - first
    out, level, span = np.zeros(len(first), np.uint64), values, 1
    while len(size) and span <= size.max():
        own = np.flatnonzero((size >= span) & (size < 2 * span))
        out[own] = combine(level[first[own]], level[end[own] - span])
        level, span = combine(level[:-span], level[span:]) if len(level) > span else level[:0], 2 * span
    return mix(out + size.astype(np.uint64))


def byte_hashes(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each word, given the words' bytes one after another. Eight bytes at a time go through combine, which is
    not linear, so regular arrangements of letters collide no more often than others."""
    begins = np.cumsum(sizes) - sizes
    padded = np.append(codes, np.zeros(8, np.uint8))
    eights = np.ndarray((len(codes) + 1,), np.dtype("<u8"), padded, 0, (1,))
    eight = lambda at, left: eights[at] & _FIRST_BYTES[np.minimum(left, 8)]
    out = eight(begins, sizes)
    for k in range(8, NEAR_BYTES, 8):
        own = np.flatnonzero((sizes > k) & (sizes <= NEAR_BYTES))
        if not len(own):
            break
        out[own] = combine(out[own], eight(begins[own] + k, sizes[own] - k))
    if len(long := np.flatnonzero(sizes > NEAR_BYTES)):
        n = (sizes[long] + 7) // 8
        end = np.cumsum(n)
        step = 8 * (np.arange(end[-1]) - np.repeat(end - n, n))
        out[long] = range_hashes(eight(np.repeat(begins[long], n) + step, np.repeat(sizes[long], n) - step), end - n, end)
    return mix(out + sizes.astype(np.uint64) * _R)


@dataclass
class Words:
    codes: np.ndarray  # the words' bytes one after another, as the alphabet reads them
    raw: np.ndarray  # bytes of all rows
    offsets: np.ndarray  # of the rows in raw
    starts: np.ndarray  # of the words in raw
    ends: np.ndarray
    first: np.ndarray  # index of each row's first word, and the number of words

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.codes, self.ends - self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(column: pa.Array, letters: Alphabet) -> Words:
    """Words of each row; null has none."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~letters.gap[raw]
    before, after = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after[:-1] = inside
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(letters.codes[raw[inside]], raw, offsets, starts, ends, np.searchsorted(starts, offsets))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds few bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; as many as there are places."""
    level, span = words[: len(words) if len(words) >= n else 0], 1
    while 2 * span <= n:
        level, span = combine(level[:-span], level[span:]), 2 * span
    return combine(level[: len(level) - (n - span)], level[n - span :]) if n > span else level


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
