"""Simple-8b word-aligned integer coding, vectorised with numpy.

A 64-bit word holds a 4-bit selector and 60 payload bits that pack as many of
the next integers as the selector says.  Integers of 2**60 and more don't fit
a word: they are packed as 0 and listed as escapes (position, value).
"""

from __future__ import annotations

import numpy as np

# Fixed values: (count, bits) of selectors 0 to 15.
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_COUNTS = np.array([n for n, _ in SELECTORS], dtype=np.int64)
#: Halvings of a chain of words.
LEAPS = 4
_LIMIT = np.uint64(1) << np.uint64(60)


def _all_of_next(fits: np.ndarray, count: int) -> np.ndarray:
    """True at i if the ``count`` entries from i on are all true; those after
    the end are."""
    run, out = 1, fits
    while run < count:
        step = min(run, count - run)
        further = np.ones(len(fits), dtype=bool)
        further[: max(0, len(fits) - step)] = out[step:]
        out = out & further
        run += step
    return out


def _chain(after: np.ndarray) -> np.ndarray:
    """0, ``after[0]``, ``after[after[0]]`` and so on, up to the end.

    Leaps of ``1 << LEAPS`` steps are followed one by one, the places between
    them by halves for all leaps at once."""
    n = len(after)
    leaps = [np.append(np.minimum(after, n), n)]
    for _ in range(LEAPS):
        leaps.append(leaps[-1][leaps[-1]])
    far, i, places = leaps.pop(), 0, []
    while i < n:
        places.append(i)
        i = int(far[i])
    starts = np.array(places, dtype=np.int64)
    for leap in reversed(leaps):
        starts = np.stack([starts, leap[starts]], axis=1).ravel()
    return starts[starts < n]


def encode(values: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """Little-endian words and the escapes of ``values`` (unsigned integers)."""
    v = values.astype(np.uint64)
    n = len(v)
    escapes: list[tuple[int, int]] = []
    if n and v.max() >= _LIMIT:
        at = np.flatnonzero(v >= _LIMIT)
        escapes = [(int(i), int(v[i])) for i in at]
        v[at] = 0
    if n == 0:
        return b"", escapes
    if v.max() < 1 << 32:
        v = v.astype(np.uint32)
    # The selector of a word that starts at i: the one with the most integers
    # whose next ones all fit; integers after the end count as zeros.
    best = np.full(n, 15, dtype=np.uint8)
    for selector in range(14, -1, -1):
        count, bits = SELECTORS[selector]
        fits = v < (1 << bits)
        if fits.any():
            best[_all_of_next(fits, count)] = selector
    starts = _chain(np.arange(n, dtype=np.int64) + _COUNTS[best])
    chosen = best[starts]
    padded = np.concatenate([v, np.zeros(240, dtype=v.dtype)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        count, bits = SELECTORS[selector]
        if bits == 0:
            continue
        rows = np.flatnonzero(chosen == selector)
        packed = words[rows]
        for k in range(count):
            packed |= padded[starts[rows] + k].astype(np.uint64) << np.uint64(bits * k)
        words[rows] = packed
    return words.astype("<u8").tobytes(), escapes


def decode(words: bytes, n: int, escapes=()) -> np.ndarray:
    """The ``n`` integers of a block as uint64."""
    w = np.frombuffer(words, dtype="<u8")
    chosen = (w >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[chosen]
    offsets = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(w) else 0, dtype=np.uint64)
    for selector in np.unique(chosen):
        count, bits = SELECTORS[selector]
        if bits == 0:
            continue
        rows = np.flatnonzero(chosen == selector)
        mask = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
        for k in range(count):
            out[offsets[rows] + k] = (w[rows] >> np.uint64(bits * k)) & mask
    out = out[:n]
    for at, value in escapes:
        out[at] = value
    return out
