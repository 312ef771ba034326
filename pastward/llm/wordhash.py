"""Words of many texts at once, and hashes of words and of word windows, as numpy arrays.

A batch of texts is one byte buffer with offsets, as Arrow holds it. A word is a run of bytes other than space and
\\t \\n \\v \\f \\r. Word hashes are polynomials over random byte values modulo 2**64, finished by a mixing step; window
hashes are polynomials over word hashes. Both come from running sums, so a window costs the same at any length. Modulo a power of two
some sequences of a thousand terms and more agree at every base, so words beyond ``LONG_WORD`` bytes get a keyed digest instead, and windows are
never that long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18  # a worker holds about 40 times as much in numbers and powers
LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finishing step of a public 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))


@lru_cache(maxsize=8)
def _base(seed: int) -> tuple[int, int]:
    base = int(seeded(1, seed)[0]) | 5
    return base, pow(base, -1, 1 << 64)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the odd base of ``seed``, or of its inverse modulo 2**64. Kept by doubling while small."""
    n = int(n)
    known = _powers.get((seed, inverse))
    if known is None or len(known) < n:
        size = 1 << max(10, (n - 1).bit_length())
        base = _base(seed)[inverse]
        known = np.ones(1, np.uint64)
        while len(known) < size:
            known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
        if size <= 2 * BLOCK_BYTES:
            _powers[seed, inverse] = known
    return known[:n]


@dataclass
class Words:
    """Words of a batch: byte spans, and where each text's words begin (``first`` has one entry more than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``lower`` turns A-Z into a-z first."""
    data = data[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def word_hashes(words: Words, seed: int) -> np.ndarray:
    """A 64-bit hash of each word; blocks of words keep the running sums small."""
    out = np.empty(len(words.start), np.uint64)
    values = seeded(256, seed)
    at = 0
    while at < len(out):
        low = words.start[at]
        stop = max(at + 1, int(np.searchsorted(words.end, low + BLOCK_BYTES, side="right")))
        high = words.end[stop - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[words.data[low:high]] * powers(high - low, seed), out=sums[1:])
        s, e = words.start[at:stop] - low, words.end[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * powers(high - low, seed, True)[s] + (e - s).astype(np.uint64))
        at = stop
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(words.end - words.start > LONG_WORD).tolist():
        digest = hashlib.blake2b(words.data[words.start[i] : words.end[i]], digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def window_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive word hashes of the batch, text borders not minded (0 if there are none)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes), seed), out=sums[1:])
    return mix((sums[width:] - sums[:n]) * powers(n, seed, True) + np.uint64(width))


def inside_texts(words: Words, width: int) -> np.ndarray:
    """Flags of the batch's windows (as in ``window_hashes``) that lie in one text."""
    n = len(words.start) - width + 1
    ok = np.ones(max(n, 0), bool)
    for k in range(1, width):  # windows that start k words before a border of texts
        before = words.first[1:-1] - k
        ok[before[(before >= 0) & (before < len(ok))]] = False
    return ok


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES, most_rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut into runs of rows with about ``most`` bytes of text, ``most_rows`` rows at most: (rows, bytes, offsets). A long text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            stop = min(stop, at + most_rows, batch.num_rows)
            yield batch.slice(at, stop - at), data, offsets[at : stop + 1]
            at = stop
