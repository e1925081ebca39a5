"""Words of a text as 64-bit hashes, for use inside tasks.

A word is a run of bytes other than ASCII white space, as ``bytes.split`` finds them.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

CACHED_WORDS = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_HASHES = _Hashes()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = mixed(out * _ODD + hashes[k : k + count])
    return out


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BLOCK_BYTES = 128_000
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[k] = np.cumprod(steps, dtype=np.uint64)
    return _tables[0][:n], _tables[1][:n]


def hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    """Hash of every word of every text, unchanged words, some texts at a time."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        group, size = [], 0
        while k < len(texts) and (not group or size + len(texts[k]) <= _BLOCK_BYTES):
            group.append(texts[k])
            size += len(texts[k])
            k += 1
        data = np.frombuffer(b" " + b" ".join(group) + b" ", np.uint8)
        space = _SPACES[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        powers, inverses = _powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        found = mixed((sums[ends] - sums[starts]) * inverses[starts])
        begins = np.cumsum([1, *[len(t) + 1 for t in group]])
        out += np.split(found, np.searchsorted(starts, begins[1:-1]))
    return out


def joined(hashes: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values, joined from halves; ``base`` is odd."""
    power, span, left = hashes, 1, n
    out, done = None, 0
    while left:
        if left & 1:
            if out is None:
                out, done = power, span
            else:
                m = max(0, len(power) - done)
                out = out[:m] * np.uint64(pow(base, span, 2**64)) + power[done : done + m]
                done += span
        left >>= 1
        if left:
            m = max(0, len(power) - span)
            power = power[:m] * np.uint64(pow(base, span, 2**64)) + power[span : span + m]
            span *= 2
    return mixed(out)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, which of them each value is, and how often each comes."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[starts], which, np.diff(np.append(starts, len(order)))
