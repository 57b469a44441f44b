"""Content-defined anchors of byte strings: every 100-byte string holds one, equal strings at the same place."""

from __future__ import annotations

import numpy as np

KMER = 32
_VALUE = np.random.default_rng(3).integers(0, 2**64, 256, np.uint64, endpoint=False)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
KEPT_POWERS = 2_000_000  # 32 MB
_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on, by doubling."""
    h, n = _VALUE[data], 1
    for m in _STEPS:
        h = h[:-n] * m + (h[n:] ^ (h[n:] >> np.uint64(29)))
        n *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding(h: np.ndarray, width: int, op, fill: int) -> np.ndarray:
    """op over h[i : i + width], from running results forwards and backwards in blocks of `width`."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, fill, np.uint64)
    padded[:len(h)] = h
    padded = padded.reshape(blocks, width)
    ahead = op.accumulate(padded, axis=1).ravel()
    back = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1:width - 1 + n])


def anchor_positions(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of texts that lie one after the other: positions and their k-mer hashes.

    An anchor is a k-mer with the smallest hash of some `length`-byte string that lies inside one text; ties all
    count, so the choice depends on the string alone."""
    if len(data) < length or not (size >= length).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - KMER + 1
    h = kmer_hashes(data)
    low = _sliding(h, width, np.minimum, 2**64 - 1)  # of each string
    inside = np.zeros(len(low) + 1, np.int8)
    good = size >= length
    np.add.at(inside, begin[good], 1)
    np.add.at(inside, begin[good] + size[good] - length + 1, -1)
    low[np.cumsum(inside[:-1]) == 0] = 0
    edge = np.zeros(width - 1, np.uint64)
    top = _sliding(np.concatenate([edge, low, edge]), width, np.maximum, 0)  # of all strings that hold a k-mer
    at = np.flatnonzero((top == h) & (top > 0))
    return at, h[at]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse; those up to two million are kept for the next call."""
    global _POWERS
    if n < len(_POWERS[0]):
        return _POWERS[0][:n + 1], _POWERS[1][:n + 1]
    made = tuple(np.full(max(n + 1, min(2 * n, KEPT_POWERS)), x, np.uint64) for x in (_BASE, _INVERSE))
    for p in made:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    if len(made[0]) <= KEPT_POWERS:
        _POWERS = made
    return made[0][:n + 1], made[1][:n + 1]


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[begin[i] : end[i]], the same for equal bytes wherever they lie."""
    n = len(data)
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:-1], out=total[1:])
    return mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))
