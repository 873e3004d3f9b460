"""Words and hashes of whole Arrow text columns, computed in numpy without a Python object per word.

The kernels work on the UTF-8 bytes of a batch. Separators are ASCII in every operator that uses them, so words
found in bytes are the words found in code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows are cut into slices of about this many bytes of text, which bounds the memory of a task. A longer text is
#: a slice of its own and is still processed whole.
SLICE_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = [0x20, *range(0x09, 0x0E)]


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


LOWER = _lower_table()
AS_IS = np.arange(256, dtype=np.uint8)


def _mask(separators) -> np.ndarray:
    mask = np.ones(256, dtype=bool)
    mask[list(separators)] = False
    return mask


#: Bytes inside words `[^\x20\x09-\x0D]+`.
NOT_SPACE = _mask(_SPACE)
#: Bytes inside words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text; capitals count as the letters they become.
ALNUM = _mask([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_powers = np.ones(1, dtype=_U)
_inverses = np.ones(1, dtype=_U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n bytes, which are at most SLICE_BYTES or a bit more."""
    global _powers, _inverses
    if len(_powers) < n:

        def run(base: int) -> np.ndarray:
            steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=_U)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        _powers, _inverses = run(_BASE), run(pow(_BASE, -1, 1 << 64))
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=_U))[0])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the row offsets into them (rows + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, at, data = column.buffers()
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, cut so that a slice has about `limit` bytes in `column`."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(batch.num_rows, max(start + 1, stop))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """Words of a slice: byte spans, hashes, and for each row the number of its first word (rows + 1)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    raw: np.ndarray
    fold: np.ndarray

    def prefixes(self, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each size n, in order, the hash of each word's first n bytes, which is that of a word of these bytes; 0 for
        shorter words."""
        sums = np.zeros(len(self.starts), dtype=_U)
        length = self.ends - self.starts
        powers, done = _power_tables(max(sizes, default=0) + 1)[0], 0
        for n in sizes:
            for j in range(done, n):
                at = np.minimum(self.starts + j, max(0, len(self.raw) - 1))
                sums += (self.fold[self.raw[at]].astype(_U) + _U(1)) * powers[j]
            done = n
            yield n, np.where(length >= n, mix(sums + _U(n)), _U(0))


def words(column: pa.Array, inside: np.ndarray, fold: np.ndarray = AS_IS) -> Words:
    """Words are maximal runs of bytes in `inside` within a row, compared after `fold`."""
    raw, offsets = text_bytes(column)
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, _U), np.zeros(len(offsets), np.int64), offsets, raw, fold)
    in_word = inside[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1] | edge[1:n]
    finishes = in_word.copy()
    finishes[:-1] &= ~in_word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return Words(starts, ends, _hashes(raw, starts, ends, fold), np.searchsorted(starts, offsets), offsets, raw, fold)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, computed for about SLICE_BYTES at a time, so a long text needs no long tables."""
    out = np.zeros(len(starts), dtype=_U)
    a = 0
    while a < len(starts):
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        if ends[b - 1] - base > SLICE_BYTES:  # one word
            out[a] = _long_sum(fold, raw[base : ends[a]]) + _U(ends[a] - base)
        else:
            part = fold[raw[base : ends[b - 1]]].astype(_U) + _U(1)
            powers, inverses = _power_tables(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=_U)
            np.cumsum(part * powers[: len(part)], out=sums[1:])
            s, e = starts[a:b] - base, ends[a:b] - base
            out[a:b] = (sums[e] - sums[s]) * inverses[s] + (e - s).astype(_U)
        a = b
    return mix(out)


def _long_sum(fold: np.ndarray, word: np.ndarray) -> np.uint64:
    powers, total = _power_tables(SLICE_BYTES + 1)[0], 0
    for at in range(0, len(word), SLICE_BYTES):
        part = fold[word[at : at + SLICE_BYTES]].astype(_U) + _U(1)
        total += int((part * powers[: len(part)]).sum()) * pow(_BASE, at, 1 << 64)
    return _U(total % (1 << 64))


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a row, and for each row the number of its first shingle (rows + 1).

    A row with fewer words, but not none, has its whole sequence as one shingle.
    """
    h, first = found.hashes, found.first
    per_row = np.diff(first)
    n = len(h)
    acc = np.zeros(n, dtype=_U)
    for j in range(min(k, n)):
        acc[: n - j] += mix(h[j:] + _U(mix_int(j + 1)))
    counts = np.where(per_row >= k, per_row - k + 1, np.minimum(per_row, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=begin[1:])
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    out = mix(acc[at]) if n else acc
    for row in np.flatnonzero((per_row > 0) & (per_row < k)):
        short = 0
        for j, x in enumerate(h[first[row] : first[row + 1]]):
            short = mix_int(short + int(x) + j)
        out[begin[row]] = mix_int(short ^ int(per_row[row]))
    return out, begin
