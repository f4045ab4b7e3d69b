"""Words and prefix polynomial hashes of many texts at once (numpy).

The texts of an Arrow column are used as one buffer of UTF-8 bytes with
offsets; nothing is split into Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def text_slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a string column of about ``limit`` bytes (whole texts): first
    row, bytes, and offsets of the texts in them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of the
    first word that is not before it (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end also ends a word
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


#: An odd number, so that it has an inverse mod 2**64.
_BASE = 0xD1342543DE82EF95


@lru_cache(maxsize=4)
def _powers(size: int, inverse: bool) -> np.ndarray:
    out = np.full(size, pow(_BASE, -1, 1 << 64) if inverse else _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class PrefixHash:
    """Polynomial hashes (mod 2**64) of any stretch of a sequence of symbols.

    A symbol is mapped to a 64-bit value that depends on the seed; equal
    stretches have equal hashes wherever they stand."""

    def __init__(self, symbols: np.ndarray, seed: int):
        size = 1 << max(20, int(len(symbols)).bit_length())
        if symbols.dtype == np.uint8:
            table = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
            symbols = table[symbols]
        else:
            symbols = mix(symbols, seed)
        self.prefix = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * _powers(size, False)[: len(symbols)], out=self.prefix[1:])
        self.back = _powers(size, True)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.back[starts], 0)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mixing of 64-bit values (the splitmix64 finalizer)."""
    x = x.astype(np.uint64) + _U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))
