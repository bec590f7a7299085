"""Words and their 64-bit hashes for whole Arrow batches of texts, by numpy over the UTF-8 bytes.

Both word patterns in use separate words by single ASCII bytes, so bytes and characters give the same words. A hash is
the polynomial of a word's bytes modulo 2**64, read off prefix sums, and mixed; it needs no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACED = np.ones(256, bool)
IS_SPACED[[32, *range(9, 14)]] = False
IS_PLAIN = np.zeros(256, bool)
IS_PLAIN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``limit`` bytes of text, so that memory follows the longest text, not the batch."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, lower-cased
    offsets: np.ndarray  # of each text in data, and the end
    text: np.ndarray  # each word's text
    start: np.ndarray  # each word's first byte in data
    end: np.ndarray
    sums: np.ndarray  # prefix sums of the polynomial
    inverses: np.ndarray

    def hashes(self, size: int | None = None) -> np.ndarray:
        """Of each word, or of its first ``size`` bytes (0 for shorter words)."""
        end = self.end if size is None else np.minimum(self.start + size, self.end)
        out = mixed((self.sums[end] - self.sums[self.start]) * self.inverses[self.start] + (end - self.start).astype(np.uint64))
        return out if size is None else np.where(self.end - self.start >= size, out, np.uint64(0))

    def bounds(self) -> np.ndarray:
        """Index of each text's first word, and the end."""
        return np.searchsorted(self.text, np.arange(len(self.offsets)))


def words(column: pa.Array, kind: np.ndarray, fold: bool = True) -> Words:
    text = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = LOWER[raw] if fold else raw
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = kind[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n + 1, bool)
    after[:n] = inside[1:]
    after[offsets[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
    inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]), dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return Words(data, offsets, np.searchsorted(offsets, start, "right") - 1, start, end, sums, inverses)


def runs(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one text, and the text of each."""
    if len(hashes) < size:
        return hashes[:0], text[:0]
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mixed(out * BASE + hashes[k : k + n])
    whole = text[:n] == text[size - 1 :]
    return out[whole], text[:n][whole]


def ragged(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list for each text out of values sorted by text."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
