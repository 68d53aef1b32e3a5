"""Word hashes of many texts at once, straight from their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mixed, release, row_keys

#: Bytes of text that are worked on at once; one longer text is its own part.
PART = 1_000_000
#: Odd multiplier of the polynomial hash; 3 modulo 4, so that few differences of powers lose low bits.
MULTIPLIER = 0x9E3779B97F4A7C17
#: White space between words, space and 0x09 to 0x0D.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def byte_table(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z have those of a-z where case does not count."""
    values = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


def split_white() -> np.ndarray:
    """Which bytes belong to words, if these are what stands between white space."""
    inside = np.ones(256, bool)
    inside[list(WHITE)] = False
    return inside


def split_letters() -> np.ndarray:
    """Which bytes belong to words, if these are runs of letters, digits, underscores and non-ASCII characters."""
    inside = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (95, 96), (128, 256)):
        inside[a:b] = True
    return inside


class Scanner:
    """Splits texts into words and hashes these: a sum of byte values, each times a power for its place in the word.

    Two different words have the same 64-bit hash with a probability of about 2**-64 each pair.
    """

    def __init__(self, inside: np.ndarray, *, lower: bool, seed: int):
        self.inside, self.values = inside, byte_table(seed, lower)
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, PART)
            for name, base in (("powers", MULTIPLIER), ("inverses", pow(MULTIPLIER, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of words before each text and after the last; no word spans texts."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._grow(n)
        word = self.inside[data]
        cuts = offsets[:-1][offsets[:-1] < n]
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[cuts] = word[cuts]
        last = word.copy()
        last[:-1] &= ~word[1:]
        cuts = offsets[1:][offsets[1:] > 0] - 1
        last[cuts] = word[cuts]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.inverses[start]), np.searchsorted(start, offsets)

    def scan(self, batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, row keys, hashes, starts) for parts of a partition; a null text is empty."""
        seen = 0
        for data in batches:
            texts = data.column(column)
            if texts.null_count:
                texts = texts.fill_null("")
            kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            keys = row_keys(seen, data.num_rows)
            seen += data.num_rows
            if not data.num_rows:
                continue
            _, places, raw = texts.buffers()
            offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            flat = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, side="right")) - 1)
                a, b = offsets[i], offsets[j]
                hashes, starts = self.words(flat[a:b], offsets[i : j + 1] - a)
                yield data.slice(i, j - i), keys[i:j], hashes, starts
                i = j
            release()
