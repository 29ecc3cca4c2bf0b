"""Many texts as one flat numpy array: spans, hashes and segment sums.

Texts of a slice lie end to end in one array of bytes or code points with
their start offsets. Words are (start, end) index arrays into it, found by
comparing each position's class with its neighbour's. A word's hash is a
polynomial over random per-symbol values, from one prefix sum over the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets; null is empty."""
    joined = [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]
    offsets = np.zeros(len(joined) + 1, np.int64)
    np.cumsum([len(x) for x in joined], out=offsets[1:])
    return np.frombuffer(b"".join(joined), np.uint8), offsets


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and n + 1 offsets."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def spaced_cuts(allowed: np.ndarray, length: int, step: int) -> list[int]:
    """0, ``length`` and the first allowed cut at or after each multiple of ``step``."""
    at = allowed[np.searchsorted(allowed, np.arange(step, length, step)).clip(max=max(0, len(allowed) - 1))] if len(allowed) else allowed
    return sorted({0, length, *(x for x in at.tolist() if x >= step)})


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross no text border."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def text_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each position, the number of the text that holds it."""
    return np.searchsorted(offsets, starts, side="right") - 1


def counts_to_offsets(owner: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n segments from the sorted segment number of each item."""
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=out[1:])
    return out


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; ``values`` holds one random 64-bit value per position."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n, _BASE), out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * powers(n + 1, _BASE_INVERSE)[starts]
    return mix64(raw ^ mix64((ends - starts).astype(np.uint64)))


def symbol_values(seed: int, size: int = 256) -> np.ndarray:
    """A random 64-bit value per symbol code, the same in every process."""
    return mix64(np.arange(size, dtype=np.uint64) + np.uint64(seed * 0x1000003))


def windows(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-keeping hashes of the k-word windows of each text, and their owner.

    ``h`` are the word hashes of all texts, ``offsets`` where each text's
    words start. Texts with fewer than k words give no window.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[j:n + j])
    owner = text_of(np.arange(n), offsets)
    whole = np.arange(n) + k <= offsets[owner + 1]
    return out[whole], owner[whole]


def long_cuts(raw, limit: int, cut) -> Iterator:
    """``raw`` (bytes or str) in pieces of about ``limit`` items, each ending after a match of the pattern ``cut``."""
    a = 0
    while len(raw) - a > limit:
        found = cut.search(raw, a + limit)
        if not found:
            break
        yield raw[a:found.end()]
        a = found.end()
    yield raw[a:] if a else raw


def text_units(column: pa.Array, cut, limit: int = 1 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (row, bytes) of about ``limit`` bytes: short texts whole, long ones in pieces cut after ``cut``."""
    unit, held = [], 0
    for row in range(len(column)):
        text = column[row].as_py()
        for piece in long_cuts(text.encode("utf-8") if text else b"", limit, cut):
            unit.append((row, piece))
            held += len(piece)
            if held >= limit:
                yield unit
                unit, held = [], 0
    if unit:
        yield unit
