"""Hashed text features for the linear models: what a text contains, not how often."""

from __future__ import annotations

import numpy as np

#: Letters, digits and bytes of other scripts stay (lower-cased before), all else is a boundary.
_WORD = np.array([c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)
_SYMBOL = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes mapped to words and boundaries."""
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


_K = 0x100000001B3
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(size: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, kept for the longest text so far."""
    if len(_powers[0]) <= size:
        for i, base in enumerate((_K, pow(_K, -1, 1 << 64))):
            _powers[i] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * size, np.uint64(base)))])
    return _powers


def prefix_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _tables(len(data))[1][:len(data)])])


def word_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word from ``prefix_sums``; equal words have equal hashes wherever they stand."""
    h = (sums[ends] - sums[starts]) * _tables(len(sums))[0][starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def words_of(text: str | None) -> np.ndarray:
    """Text, lower-cased, as bytes of words and boundaries."""
    return _WORD[np.frombuffer(f" {(text or '').lower()} ".encode(errors="replace"), dtype=np.uint8)]


_last: dict[int, np.ndarray] = {}  # scratch: the last place at which a bucket was written


def _once(found: np.ndarray, buckets: int) -> np.ndarray:
    """Each bucket once, without sorting."""
    if buckets not in _last:
        _last[buckets] = np.zeros(buckets, np.int32)
    place = np.arange(len(found), dtype=np.int32)
    _last[buckets][found] = place
    return found[_last[buckets][found] == place]


def contained(text: str | None, buckets: int) -> np.ndarray:
    """Buckets (``buckets`` is a power of two), each once, of a whole text's words, word beginnings of 4 and 5 bytes, runs of symbols, and
    classes of repetition and capitals. Bucket 0 stands for the text itself and is always there."""
    data = words_of(text)
    starts, ends = word_bounds(data)
    class_of = lambda k: np.array([k], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = lambda hashes: ((hashes >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64)
    found = [np.zeros(1, np.int64)]
    if len(starts):
        size, sums = ends - starts, prefix_sums(data)
        found.append(_once(bucket(word_hashes(sums, starts, ends)), buckets))
        found.append(bucket(class_of(1001 + min(9, int(4 * len(found[1]) / len(starts) ** 0.9)))))
        for n in (4, 5):
            some = starts[size >= n]
            found.append(bucket(word_hashes(sums, some, some + n) + (np.uint64(n) << np.uint64(20))))
    raw = np.frombuffer((text or "").encode(errors="replace"), dtype=np.uint8)
    if len(raw) >= 3:
        at = np.flatnonzero(_SYMBOL[raw[:-2]])
        at = at[_SYMBOL[raw[at + 1]] | (raw[at + 1] == 32)]
        found.append(bucket((raw[at].astype(np.uint64) << np.uint64(16) | raw[at + 1].astype(np.uint64) << np.uint64(8) | raw[at + 2]) * np.uint64(0xBF58476D1CE4E5B9)))
        found.append(bucket(class_of(2001 + int(8 * np.count_nonzero((raw >= 65) & (raw <= 90)) / len(raw)))))
    return _once(np.concatenate(found), buckets)


def common_only(bags: list[np.ndarray], buckets: int, least: int = 3) -> list[np.ndarray]:
    """Training sets without the buckets that fewer than ``least`` of them have, which are mostly words of a single text."""
    count = np.zeros(buckets, np.int64)
    for at in bags:
        count[at] += 1
    count[0] = least
    return [at[count[at] >= least] for at in bags]
