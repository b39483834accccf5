"""Vectorised hashes of words, word windows and byte windows (numpy, used inside tasks).

All hashes are polynomial (Rabin-Karp) over the 64-bit integers, taken from prefix sums, so that a
window's hash costs the same at any width; they end in a mixing step. Equal content gives equal
hashes on every machine; for different content a collision has a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 20  # bytes of text whose words are hashed at once
MOST_KEPT = 1 << 21  # powers that a process keeps
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):  # wraps around, as it should
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


class Kept(dict):
    """What a process has computed; travels empty when a task function is sent."""

    def __reduce__(self):
        return Kept, ()


_powers = Kept()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers up to n at least."""
    size = 1 << max(16, int(n).bit_length())
    if len(_powers.get("p", ((),))[0]) < size:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > MOST_KEPT:
            return out[0], out[1]
        _powers["p"] = (out[0], out[1])
    return _powers["p"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """sums[i]: of values[j] * BASE**j for j < i."""
    n = len(values)
    out = np.zeros(n + 1, U)
    np.add.accumulate(values * powers(n)[0][:n], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U))


def windows_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of a width, by start."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U)
    return mix((sums[width:] - sums[:n]) * powers(len(sums))[1][:n] + U(width))


def bytes_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(BYTE_VALUES[data])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes, as split by the six ASCII blanks."""
    edge = np.diff(np.concatenate(([True], BLANK[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and each text's number of words."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        cut = at + BLOCK
        while cut < len(data) and not BLANK[data[cut - 1]]:  # only blanks are cut at
            more = np.flatnonzero(BLANK[data[cut : cut + BLOCK]])
            cut = min(len(data), cut + (int(more[0]) + 1 if len(more) else BLOCK))
        part = data[at:cut]
        start, end = word_spans(part)
        hashes.append(spans_hash(bytes_sums(part), start, end))
        starts.append(start + at)
        at = cut
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), bounds))


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places at which windows inside one text start, and each text's number of windows."""
    n = np.maximum(counts - width + 1, 0)
    first = np.cumsum(counts) - counts
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def word_windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words inside one text, and each text's number of windows."""
    at, n = window_starts(counts, width)
    return windows_hash(prefix_sums(hashes), width)[at], n


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of each window, the leftmost of equal ones.

    Block prefixes and suffixes: each window spans at most two blocks of its width.
    """
    n = len(values)
    bits = max(24, int(n).bit_length())  # the same for all texts up to 16 MB, so that equal bytes choose alike
    packed = (values >> U(bits) << U(bits)) | np.arange(n, dtype=U)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(U).max, U)
    padded[:n] = packed
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - width + 1], left[width - 1 : n])
    return (least & U((1 << bits) - 1)).astype(np.int64)
