"""Sets of word shingles and their PartEnum signatures (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each value."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``width`` words; of the whole sequence
    if it has fewer; none without words.  Words are lower-cased (A-Z) and end at ASCII
    white space."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = mixed(out * _M1 + h[j:j + n])
    return np.unique(out)


#: Low bits of a signature: its band, and below that its part.
BAND_BITS, PART_BITS = 7, 13


@dataclass(frozen=True)
class Layout:
    """How one size band is cut: ``parts`` first-level parts of ``cells`` cells each; a part
    is good for a pair when at most ``errors`` of their differing features fall into it, and
    then one of the subsets that leave ``errors`` cells out is equal.  ``spare`` parts more
    than the pigeonhole needs allow a set to leave out subsets of fewer than ``least``
    features, unless they touch more than ``spare`` parts; and a pair shares at least
    ``spare + 1`` parts, less those that its sets touched."""

    parts: int
    cells: int
    errors: int
    spare: int
    least: int

    @property
    def subsets(self) -> np.ndarray:
        return _subsets(self.cells, self.errors)


@lru_cache
def _subsets(cells: int, errors: int) -> np.ndarray:
    return np.array([[c not in out for c in range(cells)] for out in combinations(range(cells), errors)])


@dataclass(frozen=True)
class Scheme:
    """PartEnum over size bands for ``100 * intersection >= percent * union``.

    A pair is found under the band of its larger set, so a set signs for its own band and
    for each band that a larger partner can lie in.  Within a band of sets up to ``r`` a
    pair differs in at most ``2 r (100 - percent) / (100 + percent)`` features.
    ``exact``: leave no subset out (small inputs, second round)."""

    percent: int
    salt: int = 0
    exact: bool = False
    ratio: float = 1.25

    def top(self, band: int) -> int:
        return int(self.ratio ** band)

    def band(self, size: int) -> int:
        b = 0
        while self.top(b) < size:
            b += 1
        return b

    def bands(self, size: int) -> range:
        return range(self.band(size), self.band(size * 100 // self.percent) + 1)

    def layout(self, band: int) -> Layout:
        return _layout(self, band)

    def signatures(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Signatures of a set, how many parts each pair of the signature's band must share
        at least, and whether the set left out more than the spare parts allow.

        A signature holds its band and part in its low bits (:data:`BAND_BITS`, :data:`PART_BITS`)."""
        found, needs, unsafe = [], [], False
        for band in self.bands(len(features)):
            lay = self.layout(band)
            h = mixed(features + np.uint64((self.salt * 1000 + band + 1) * 0x632BE59BD9B4E019 % 2**64))
            part = ((h >> np.uint64(40)) * np.uint64(lay.parts) >> np.uint64(24)).astype(np.int64)
            cell = part * lay.cells + (h & np.uint64(0xFFFF)).astype(np.int64) % lay.cells
            n = lay.parts * lay.cells
            value = mixed(h)
            low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
            high = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
            sums = (low + (high << np.uint64(32))).reshape(lay.parts, lay.cells)
            chosen = lay.subsets.T
            signed = sums @ chosen.astype(np.uint64)
            name = np.arange(signed.size, dtype=np.uint64).reshape(signed.shape) + np.uint64(band << 40)
            signed = mixed(signed + mixed(name * _M1)) >> np.uint64(BAND_BITS + PART_BITS)
            signed = signed << np.uint64(BAND_BITS) | np.uint64(band % (1 << BAND_BITS))
            place = np.arange(lay.parts, dtype=np.uint64)[:, None] % np.uint64(1 << PART_BITS)
            signed = signed << np.uint64(PART_BITS) | place
            need = 1
            if lay.least:
                counts = np.bincount(cell, minlength=n).reshape(lay.parts, lay.cells)
                poor = counts @ chosen.astype(np.int64) < lay.least
                touched = int(poor.any(1).sum())
                unsafe |= touched > lay.spare
                if lay.parts <= 1 << PART_BITS:
                    need = max(1, lay.spare + 1 - touched)
                signed = signed[~poor]
            found.append(signed.ravel())
            needs.append(np.full(signed.size, need, np.int32))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), False
        return np.concatenate(found), np.concatenate(needs), unsafe


@lru_cache(maxsize=None)
def _layout(scheme: Scheme, band: int) -> Layout:
    top = scheme.top(band)
    k = 2 * top * (100 - scheme.percent) // (100 + scheme.percent)
    if not k:
        return Layout(1, 1, 0, 0, 0)
    smallest = max(1, top / scheme.ratio * scheme.percent / 100)
    if k >= 8 and not scheme.exact:
        need = k // 2 + 1
        spare = ceil(0.15 * need)
        # leaving out subsets of one feature pays where they are rare: at lower thresholds
        # parts are small, and almost every set would touch more parts than are spare
        held = smallest / (need + spare) * 2 / 3
        return Layout(need + spare, 3, 1, spare, 2 if held >= 4 else 1)
    # the fewest signatures whose subsets hold six features of the smallest set on average
    best = None
    for errors in range(min(k, 4) + 1):
        parts = k // (errors + 1) + 1
        for cells in range(errors + 1, errors + 6):
            held = smallest / parts * (cells - errors) / cells
            cost = (max(0, 6 - held), parts * comb(cells, errors))
            best = min(best, (cost, Layout(parts, cells, errors, 0, 0)), key=lambda x: x[0]) if best else \
                (cost, Layout(parts, cells, errors, 0, 0))
    return best[1]


def verified_links(sets: list[np.ndarray], other: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) that link, of one block (i < j) or of two, by shared features; features
    are taken some at a time, so memory is that of the counts."""
    both = sets + (other or [])
    sizes = np.array([len(s) for s in both], np.int64)
    rows = np.repeat(np.arange(len(both)), sizes)
    flat = np.concatenate(both) if both else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    column = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])]) if len(flat) else np.zeros(0, np.int64)
    shared = np.bincount(column) > 1 if len(flat) else np.zeros(0, bool)
    kept = shared[column]
    rows, column = rows[kept], np.searchsorted(np.flatnonzero(shared), column[kept])
    counts = np.zeros((len(both), len(both)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        block = np.zeros((len(both), 4096), np.float32)
        block[rows[a:b], column[a:b] - at] = 1
        counts += block @ block.T
    n = len(sets)
    i, j = np.nonzero(np.triu(100 * counts >= percent * (sizes[:, None] + sizes[None, :] - counts), 1))
    for a, b in zip(i.tolist(), j.tolist()):
        if other is None or a < n <= b:
            yield a, b
