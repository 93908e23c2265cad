"""Words of many texts at once, and hashes of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: For each of two independent hashes: the start of a word's hash, and the base of the sum over a run.
_SEEDS = ((np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93), (np.uint64(0xC2B2AE3D27D4EB4F), 0xA24BAED4963EE407))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: where each starts, its length and its text's number. Texts are bytes, parted by a space."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
        self.raw = _LOWER[raw] if lower else raw
        space = _IS_SPACE[self.raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.r_[0, edge]
        self.start, end = edge[::2], edge[1::2]
        self.length = end - self.start
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.per_text = np.bincount(self.text, minlength=len(texts))

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, of all its bytes and its length."""
        at = np.lib.stride_tricks.as_strided(self.raw[: len(self.raw) - 7], (len(self.raw) - 7, 8), (1, 1))
        h = mix(self.length.astype(np.uint64) * _SEEDS[which][0])
        on, k = np.arange(len(h)), 0
        while len(on):
            left = np.minimum(self.length[on] - k, 8)
            x = np.ascontiguousarray(at[np.minimum(self.start[on] + k, len(at) - 1)]).view("<u8").ravel() & _MASK[left]
            h[on] = mix((h[on] + _SEEDS[which][0]) ^ x)
            k += 8
            on = on[self.length[on] > k]
        return h

    def runs(self, n: int, which: int = 0, hashed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all runs of n words within one text."""
        h = self.hashes(which) if hashed is None else hashed
        if len(h) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _powers(which, len(h) + 1)
        total = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]
        first = np.flatnonzero(self.text[n - 1 :] == self.text[: len(h) - n + 1])
        return first, mix((total[first + n] - total[first]) * down[first])


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if which not in _kept or len(_kept[which][0]) < n:
        size, out = max(n, 1 << 16), []
        base = _SEEDS[which][1]
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _kept[which] = tuple(out)
    return _kept[which]


def pack(a: np.ndarray) -> bytes:
    """Compressed, byte by byte of each item; sorted numbers go as differences."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else np.zeros(0, np.uint8)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(b, n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def differences(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))
