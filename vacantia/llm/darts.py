"""DartMinHash: weighted MinHash signatures from hashed darts, for a batch of sparse sets at once.

Every element owns a plane of weight x rank on which darts lie at density one, placed by hashing the element alone. A
set sees the darts below its element's weight; per coordinate of the signature it keeps the one of least rank. Two sets
agree in a coordinate with the probability of their weighted Jaccard similarity. Darts are thrown slab by slab of
rising rank, and a set drops out as soon as all its coordinates are filled: what comes later can't change them.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: (lowest rank, height) of the slabs: even ones first, then doubling up to the highest rank, 65,536.
_SLABS = [(float(i), 1.0) for i in range(8)] + [(float(2**i), float(2**i)) for i in range(3, 16)]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def _counts(area: float) -> np.ndarray:
    """The Poisson count of a cell of this area for each 16-bit uniform number."""
    p, total, cut = np.exp(-area), 0.0, []
    for n in range(int(area + 12 * area**0.5 + 12)):
        total += p
        cut.append(total)
        p *= area / (n + 1)
    return np.searchsorted(np.array(cut), (np.arange(65536) + 0.5) / 65536)


_COUNTS: dict[float, np.ndarray] = {}


def _thrown(elements: np.ndarray, weight: np.ndarray, slab: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element's place, rank, name) of the darts each element sees in one cell: a slab of rank by a span of weight."""
    low, height = _SLABS[slab]
    width, low_w = float(2**wide), float(2**wide - 1)
    area = width * height
    if area not in _COUNTS:
        # over such an area the count hardly varies
        _COUNTS[area] = _counts(area) if area < 600 else np.full(65536, int(area))
    cell = mix((elements + np.uint64(wide * 64 + slab + 1)) * _ODD)
    count = _COUNTS[area][(cell >> np.uint64(48)).astype(np.int64)]
    owner = np.repeat(np.arange(len(cell)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(cell[owner] + nth.astype(np.uint64) * _ODD)
    reach = (weight - low_w) * (2.0**24 / width)
    seen = (dart >> np.uint64(40)).astype(np.float64) < reach[owner]
    dart, owner = dart[seen], owner[seen]
    rank = low + ((dart >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float64) * (height / 2**24)
    return owner, rank, mix(dart + _ODD)


def signatures(elements: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) signature of the sets 0..n-1; `row` says which set each element (uint64) with its weight (> 0) is of.

    A set without elements keeps empty coordinates; so does one of so little weight in all (under a few thousandths of
    k) that the highest rank leaves some unfilled.
    """
    out = np.full(n * k, EMPTY, np.uint64)
    todo = np.bincount(row, weights=weight, minlength=n) > 0
    e, r, w = elements, row, weight
    for slab in range(len(_SLABS)):
        keep = todo[r]
        if not keep.all():
            e, r, w = e[keep], r[keep], w[keep]
        if not len(e):
            break
        for wide in range(int(np.log2(1 + w.max())) + 1):
            here = np.flatnonzero(w > 2**wide - 1)
            if not len(here):
                continue
            owner, rank, name = _thrown(e[here], w[here], slab, wide)
            place = r[here[owner]] * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(out, place, ((rank * 2**16).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF)))
        todo &= (out.reshape(n, k) == EMPTY).any(axis=1)
    return out.reshape(n, k)


def band_keys(signature: np.ndarray, rows: int, passes: int = 1) -> np.ndarray:
    """(n, passes * k / rows) keys as int64, one for each band of `rows` coordinates; the band's number is part of its key.

    Each pass cuts all coordinates into bands; bands of different passes share one coordinate at most, so that they
    are nearly as good as bands of coordinates of their own.
    """
    n, k = signature.shape
    side = k // rows
    names = signature & np.uint64(0xFFFFFFFF)
    out = np.empty((n, passes * side), np.uint64)
    for p in range(passes):
        keys = np.tile(np.arange(p * side + 1, (p + 1) * side + 1, dtype=np.uint64) * _ODD, (n, 1))
        for j in range(rows):
            keys = mix(keys ^ names[:, j * side + (np.arange(side) + p * j) % side]) * _ODD
        out[:, p * side : (p + 1) * side] = keys
    return out.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """(n, 4) int64: the last four bits of the first 64 coordinates, sixteen to a number, to compare pairs by cheaply."""
    nibbles = (signature[:, :64] & np.uint64(15)).reshape(len(signature), 4, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
