"""Longest common extensions by a difference cover, for whole arrays of positions at once."""

from __future__ import annotations

import numpy as np

# The residues {0, 1, 3, 9} differ, modulo 13, by every residue.
COVER = 13
RESIDUES = (0, 1, 3, 9)


def _shifts() -> np.ndarray:
    """For residues a, b of two positions: the least step that puts both on the cover."""
    out = np.empty((COVER, COVER), dtype=np.int64)
    for a in range(COVER):
        for b in range(COVER):
            out[a, b] = next(s for s in range(COVER) if (a + s) % COVER in RESIDUES and (b + s) % COVER in RESIDUES)
    return out


SHIFTS = _shifts()
_NTH = np.full(COVER, -1, dtype=np.int64)
_NTH[list(RESIDUES)] = np.arange(len(RESIDUES))


def _named(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Ranks of the pairs (a, b), with 0 <= b < base, in their order."""
    return np.unique(a * base + b, return_inverse=True)[1]


class CoverExtensions:
    """How far the sequences from two positions agree.

    Only suffixes at cover-sampled positions are sorted: windows of ``COVER`` words get
    names in their order, and names are doubled until all suffixes differ. Neighbours'
    common lengths lie in a sparse table of minima. A question compares the few words up to
    the step that brings both positions onto the cover, then looks up one minimum.

    ``words`` ends with a value that occurs nowhere else, which stops every extension.
    Values that end one text are to be unique, so that no extension leaves it.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        least = int(words.min()) - 1
        self.words = np.concatenate([words, least - np.arange(COVER)])
        codes = np.unique(self.words, return_inverse=True)[1].astype(np.int64)
        base = int(codes.max()) + 1
        places = (np.arange(-(-n // COVER))[:, None] * COVER + np.array(RESIDUES)).ravel()
        places = places[places < n]
        m, step = len(places), len(RESIDUES)
        name = codes[places]
        for t in range(1, COVER):
            name = _named(name, codes[places + t], base)
        levels = [name.astype(np.int32)]
        span = step  # entries that the names cover, windows apart
        while int(name.max()) + 1 < m:
            follow = np.zeros(m, dtype=np.int64)
            follow[: max(m - span, 0)] = name[span:] + 1
            name = _named(name, follow, m + 1)
            levels.append(name.astype(np.int32))
            span *= 2
        self.rank = name
        order = np.empty(m, dtype=np.int64)
        order[name] = np.arange(m)
        self.minima = self._table(self._neighbours(order, places, levels, step))

    def _neighbours(self, order: np.ndarray, places: np.ndarray, levels: list[np.ndarray], step: int) -> np.ndarray:
        """Common words of each sampled suffix and the next one in their order."""
        a, b = order[:-1].copy(), order[1:].copy()
        windows = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < len(order)
            same = inside.copy()
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            windows[same] += 1 << k
            a[same] += step << k
            b[same] += step << k
        common = windows * COVER
        return (common + self._few(places[a], places[b], np.full(len(a), COVER))).astype(np.int32)

    @staticmethod
    def _table(low: np.ndarray) -> list[np.ndarray]:
        table, width = [low], 1
        while 2 * width <= len(low):
            last = table[-1]
            table.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2
        return table

    def _few(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words in common from i and j on, up to ``limit`` of each pair."""
        out = np.zeros(len(i), dtype=np.int64)
        live = np.flatnonzero(limit > 0)
        while len(live):
            at = out[live]
            live = live[self.words[i[live] + at] == self.words[j[live] + at]]
            out[live] += 1
            live = live[out[live] < limit[live]]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common from i and from j on, for i <> j."""
        shift = SHIFTS[i % COVER, j % COVER]
        out = self._few(i, j, shift)
        far = np.flatnonzero(out == shift)
        x, y = i[far] + shift[far], j[far] + shift[far]
        index = [self.rank[p // COVER * len(RESIDUES) + _NTH[p % COVER]] for p in (x, y)]
        low, high = np.minimum(*index), np.maximum(*index)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            some = level == k
            table = self.minima[k]
            out[far[some]] += np.minimum(table[low[some]], table[high[some] - (1 << k)])
        return out
