"""Vectorised work on the bytes of many texts at once.

All functions take what Arrow gives for a binary column: one buffer with the
bytes of every row, and the offsets of the rows. Nothing is copied per row and
no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes handled at a time. A longer text is handled alone, whole.
CHUNK = 1 << 19

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)  # odd, so a power of it has an inverse
#: The prime and the base of the second hash of a word.
_PRIME, _BASE = (1 << 31) - 1, 1_389_796_277


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary array; null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = CHUNK):
    """(first row, last row + 1) of runs of rows of at most `most` bytes; a longer row is a run alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of `marks` over each row."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Shingler:
    """64-bit hashes of the words and of the word shingles of texts.

    Words are maximal runs of bytes other than those in `gaps` (space and
    0x09-0x0D); with `fold_case`, A-Z count as a-z. A text of fewer than `k` words (but at least one) has one shingle,
    its whole sequence of words. Equal hashes are taken as equal shingles.

    A word's hash joins two polynomials in its bytes: one modulo 2^64, which alone
    is the same for certain words of 1,024 bytes whatever its base, and one modulo
    the prime 2^31 - 1, for which that is not so.
    """

    def __init__(self, k: int = 5, fold_case: bool = True, gaps: tuple[int, ...] = (32, 9, 10, 11, 12, 13)):
        self.k = k
        self.powers = np.ones(1, U64)
        self.inverse = np.ones(1, U64)
        self.prime_powers = np.ones(1, U64)
        self.prime_inverse = np.ones(1, U64)
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
        if fold_case:
            upper = np.arange(65, 91)
            self.value[upper] = self.value[upper + 32]
        self.inside = np.ones(256, bool)
        self.inside[list(gaps)] = False

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, CHUNK)
            for name, step in (("powers", _STEP), ("inverse", U64(pow(int(_STEP), -1, 1 << 64)))):
                table = np.full(size, step, U64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=U64))
            for name, step in (("prime_powers", _BASE), ("prime_inverse", pow(_BASE, -1, _PRIME))):
                table = np.ones(1, U64)
                while len(table) < size:
                    table = np.concatenate([table, table * U64(pow(step, len(table), _PRIME)) % U64(_PRIME)])
                setattr(self, name, table[:size])

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of all words in order."""
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        inside = self.inside[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and offsets into them for each row."""
        n = len(data)
        if not n:
            return np.empty(0, U64), np.zeros(len(offsets), np.int64)
        starts, ends = self.spans(data, offsets)
        return self.hashes(data, starts, ends), np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each span of bytes."""
        n = len(data)
        self._grow(n)
        total = np.zeros(n + 1, U64)
        np.cumsum(self.value[data] * self.powers[:n], out=total[1:])
        found = (total[ends] - total[starts]) * self.inverse[starts]
        prime = U64(_PRIME)
        terms = (self.value[data] >> U64(33)) * self.prime_powers[:n]
        np.cumsum((terms & prime) + (terms >> U64(31)), out=total[1:])  # terms modulo the prime, not fully reduced
        other = (total[ends] - total[starts]) % prime * self.prime_inverse[starts] % prime
        return mix(found + (ends - starts).astype(U64) + mix(other + _STEP))

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles in order (repeats included), and offsets into them for each row."""
        words, at = self.words(data, offsets)
        return self.fold(words, at)

    def fold(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, count = self.k, np.diff(at)
        made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        out_at = np.concatenate([[0], np.cumsum(made)])
        out = np.empty(out_at[-1], U64)
        if len(words) >= k:
            m = len(words) - k + 1
            sums = words[:m].copy()
            for j in range(1, k):
                sums *= _STEP
                sums += words[j : j + m]
            long = count >= k
            rows = np.repeat(np.arange(len(count)), np.where(long, made, 0))
            inner = np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(np.where(long, made, 0))])[:-1], np.where(long, made, 0))
            out[out_at[rows] + inner] = mix(sums[at[rows] + inner])
        for row in np.flatnonzero((count > 0) & (count < k)):
            value = U64(int(count[row]))
            with np.errstate(over="ignore"):
                for word in words[at[row] : at[row + 1]]:
                    value = value * _STEP + word
            out[out_at[row]] = mix(np.array([~value]))[0]
        return out, out_at
