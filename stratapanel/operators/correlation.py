"""Pairwise-complete correlations of many entities without their matrix.

A pair's correlation depends on the entities' values and, through the times that both have, on their patterns of missing ones only. Of two patterns all
pairs' correlations are the products of two thin matrices, each entity's values over the common times centred and scaled. So sums over pairs and products
with the matrix are linear in the entities, for each pattern with many members; those of the others are taken tile by tile. The matrix is never held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: members from which a pattern is multiplied by thin matrices, and rows and columns of a tile of the matrix of the others
BIG, TILE_ROWS, TILE_COLUMNS = 32, 256, 2048


class Correlations:
    """Of the columns of ``x`` (times x entities, NaN where missing); 0 where undefined, on the diagonal too. Entities are held by pattern: ``order``."""

    def __init__(self, x: np.ndarray):
        seen = ~np.isnan(x.T)
        values = np.where(seen, x.T, 0.0)
        values[~np.isfinite(values).all(1)] = 0  # an infinite value leaves nothing to correlate
        patterns, code, count = np.unique(seen, axis=0, return_inverse=True, return_counts=True)
        by_size = np.argsort(-count, kind="stable")
        place = np.empty_like(by_size)
        place[by_size] = np.arange(len(by_size))
        code = place[code.ravel()]
        self.order = np.argsort(code, kind="stable")
        self.values = np.where(seen, values - values.sum(1, keepdims=True) / np.maximum(seen.sum(1, keepdims=True), 1), 0.0)[self.order]
        self.code, self.patterns = code[self.order], patterns[by_size].astype(float)
        self.ends = np.cumsum(count[by_size])
        self.starts = self.ends - count[by_size]
        self.big = int((count >= BIG).sum())
        self.cut = int(self.ends[self.big - 1]) if self.big else 0
        self.scale: np.ndarray | None = None

    def members(self, p: int) -> slice:
        return slice(self.starts[p], self.ends[p])

    def scaled(self, p: int, q: int) -> np.ndarray:
        """Values of the members of pattern ``p`` over the times that ``q`` has, too, of mean 0 and length 1; all 0 where they don't vary."""
        both = self.patterns[p] * self.patterns[q]
        x = self.values[self.members(p)] * both
        if both.sum() < 2:
            return np.zeros_like(x)
        whole = np.einsum("ij,ij->i", x, x)
        x -= (x.sum(1) / both.sum())[:, None]
        x *= both
        rest = np.einsum("ij,ij->i", x, x)
        x *= np.where(rest > 1e-12 * whole, 1 / np.sqrt(np.where(rest > 0, rest, 1)), 0.0)[:, None]
        return x

    def _against(self, rows: slice, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row over each pattern's times: the scale, the sum and the mean."""
        x, seen = self.values[rows], self.patterns[self.code[rows]]
        n, s, ss = seen @ patterns.T, x @ patterns.T, (x * x) @ patterns.T
        mean = s / np.maximum(n, 1)
        rest = ss - s * mean
        vary = (n >= 2) & (rest > 1e-12 * ss)
        return np.where(vary, 1 / np.sqrt(np.where(vary, rest, 1)), 0.0), s, mean

    def tile(self, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        """The correlations of rows ``i`` with rows ``j``, and which of them are defined."""
        (p, at), (q, to) = (np.unique(self.code[z], return_inverse=True) for z in (i, j))
        (scale, _, mean), (other, total, _) = self._against(i, self.patterns[q]), self._against(j, self.patterns[p])
        scale, other = scale[:, to], other.T[at]
        out = self.values[i] @ self.values[j].T
        out -= mean[:, to] * total.T[at]
        out *= scale
        out *= other
        return out, (scale > 0) & (other > 0)

    def tiles(self) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
        """The rows of small patterns against all rows."""
        n = len(self.values)
        for low in range(self.cut, n, TILE_ROWS):
            i = slice(low, min(low + TILE_ROWS, n))
            for start in range(0, n, TILE_COLUMNS):
                j = slice(start, min(start + TILE_COLUMNS, n))
                yield i, j, *self.tile(i, j)

    def scales(self) -> np.ndarray:
        """Of each member of a pattern with many: the inverse length of its values over the times that each such pattern has, too, less their mean."""
        if self.scale is None:
            self.scale = np.empty((self.cut, self.big))
            for low in range(0, self.cut, TILE_COLUMNS):
                rows = slice(low, min(low + TILE_COLUMNS, self.cut))
                self.scale[rows] = self._against(rows, self.patterns[: self.big])[0]
        return self.scale

    def times(self, v: np.ndarray) -> np.ndarray:
        """The matrix times ``v``, both in the order of the patterns.

        ``scaled`` values are products of the values with what has a row a time, so no copy of the values is made for each pair of patterns.
        """
        out, scale = np.zeros_like(v), self.scales()

        def sums(x: np.ndarray, size: np.ndarray, mean: np.ndarray, both: np.ndarray, of: np.ndarray) -> np.ndarray:
            of = size * of
            return both[:, None] * (x.T @ of - mean @ of)

        def spread(x: np.ndarray, size: np.ndarray, mean: np.ndarray, both: np.ndarray, w: np.ndarray) -> np.ndarray:
            part = x @ (both[:, None] * w)
            part -= mean[:, None] * (both @ w)
            part *= size
            return part

        for p in range(self.big):
            for q in range(p, self.big):
                i, j, both = self.members(p), self.members(q), self.patterns[p] * self.patterns[q]
                if both.sum() < 2:
                    continue
                x, y = self.values[i], self.values[j]
                a = x, scale[i, q, None], x @ both / both.sum(), both
                b = a if p == q else (y, scale[j, p, None], y @ both / both.sum(), both)
                out[i] += spread(*a, sums(*b, v[j]))
                if p != q:
                    out[j] += spread(*b, sums(*a, v[i]))
        for i, j, part, _ in self.tiles():
            out[i] += part @ v[j]
            if big := min(max(self.cut - j.start, 0), part.shape[1]):
                out[j.start : j.start + big] += part[:, :big].T @ v[i]
        return out

    def pairs(self, side: np.ndarray | None = None) -> tuple[float, int]:
        """Sum and number of the defined correlations of the pairs of two entities, or of one on each ``side`` (booleans in the order of ``x``): from
        each pattern's sums, and tile by tile for small patterns."""
        total, count = 0.0, 0
        sides = [np.ones(len(self.values), bool)] if side is None else [side[self.order], ~side[self.order]]
        for p in range(self.big):
            for q in range(p, self.big):
                (a, n), (b, m) = (self._sums(p, q, sides), self._sums(q, p, sides))
                if side is not None:
                    total += float(a[0] @ b[1]) + (float(a[1] @ b[0]) if p != q else 0)
                    count += n[0] * m[1] + (n[1] * m[0] if p != q else 0)
                elif p != q:
                    total += float(a[0] @ b[0])
                    count += n[0] * m[0]
                else:
                    total += (float(a[0] @ a[0]) - n[0]) / 2
                    count += n[0] * (n[0] - 1) // 2
        for i, j, part, known in self.tiles():
            of, to = np.arange(i.start, i.stop)[:, None], np.arange(j.start, j.stop)
            once = (to < self.cut) | (to > of)  # of two members of small patterns
            if side is not None:
                once &= sides[0][i][:, None] != sides[0][j]
            total += float(part[once].sum())
            count += int(known[once].sum())
        return total, count

    def _sums(self, p: int, q: int, sides: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        a = self.scaled(p, q)
        known, at = a.any(1), self.members(p)
        return [a[s[at]].sum(0) for s in sides], [int(known[s[at]].sum()) for s in sides]

    def components(self, k: int, tolerance: float = 1e-9, blocks: int = 6) -> np.ndarray:
        """Scores on the first ``k`` principal components of the matrix's columns, an entity a row in the order of ``x``; each component's largest loading is positive.

        A space is begun from the entities' own values, which hold all of it if none is missing, and grown by what the matrix and its transpose make of the
        best vectors beyond it, until the scores stay where they are; after ``blocks`` times it is begun anew from its best vectors. It grows by a
        few vectors at a time, so that a task holds little more than the values; vectors are rows, written in place.
        """
        n = len(self.values)
        length = np.sqrt((self.values**2).sum(1, keepdims=True))
        new = _orthonormal((self.values / np.where(length > 0, length, 1)).T, np.zeros((0, n)), 1e-12)
        grow = k + 4
        basis, image = (np.empty((max(len(new), 2 * grow) + blocks * grow, n)) for _ in range(2))
        m, last = 0, None
        while True:
            basis[m : m + len(new)], image[m : m + len(new)] = new, self.times(new.T).T
            m += len(new)
            size, turn = np.linalg.eigh(image[:m] @ image[:m].T)
            size, turn = np.sqrt(np.maximum(size[::-1], 0)), turn[:, ::-1]
            scores = (turn[:, :k] * size[:k]).T @ basis[:m]
            if last is not None and last.shape == scores.shape:
                same = np.where((scores * last).sum(1) < 0, -1, 1)[:, None]
                if np.abs(scores - last * same).max() <= tolerance * np.abs(scores).max():
                    break
            last = scores
            new = self.times((turn[:, :grow].T @ image[:m]).T).T
            if m + grow > len(basis):
                m = min(m, 2 * grow)
                for rows in (basis, image):
                    rows[:m] = turn[:, :m].T @ rows[: len(turn)]
                turn = np.eye(m)
            new = _orthonormal(new, basis[:m], 1e-12 * max(size, default=0) ** 2)
            if not len(new):
                break
        out, loadings = np.zeros((n, k)), np.zeros((n, k))
        out[self.order, : len(scores)], loadings[self.order, : len(scores)] = scores.T, (turn[:, :k].T @ image[:m]).T
        return out * np.where(loadings[np.abs(loadings).argmax(0), np.arange(k)] < 0, -1, 1)


def _orthonormal(y: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of the centred rows of ``y`` beyond ``basis``, without directions of length ``least`` or 1e-7 of the longest one. Each row counts
    by what it has beyond ``basis``, however little that is."""
    y = y - y.mean(1, keepdims=True)
    for rounds in range(4):
        y -= (y @ basis.T) @ basis
        y -= y.mean(1, keepdims=True)
        if not rounds:
            size = np.sqrt(np.einsum("ij,ij->i", y, y))
            y = y[size > least] / size[size > least, None]
            continue
        size, turn = np.linalg.eigh(y @ y.T)
        size = np.sqrt(np.maximum(size, 0))
        kept = size > (1e-7 * max(size, default=0) if rounds == 1 else 0.5)
        y = (turn[:, kept].T @ y) / size[kept, None]
    return y
