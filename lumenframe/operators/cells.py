"""Exact search among vectors held in memory: rows lie in blocks round pivots, and the triangle inequality leaves blocks out.

Products are made in single precision with a proven bound on their error; where the bound leaves a case open, and for every
distance that is given out, differences in double precision decide. All steps work on pieces of fixed size.
"""

from __future__ import annotations

import numpy as np

HELD = 48 << 20  # bytes of vectors that are broadcast at once
ROWS = 1_024  # most rows of a block
CHUNK = 2_048  # rows compared with a block at a time
PAIRS = 16_384  # pairs compared by differences at a time


def passes(n: int, dim: int) -> int:
    """Broadcasts for ``n`` vectors."""
    return max(1, -(-n * dim * 8 // HELD))


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


class Cells:
    """``x``: finite rows in double precision, reordered by block; ``order`` says which they were."""

    def __init__(self, x: np.ndarray, pivots: int = 64):
        n = len(x)
        self.centre = x.mean(0) if n else np.zeros(x.shape[1])
        s = x[np.random.default_rng(0).permutation(n)[:8_192]] - self.centre
        p = s[:pivots]
        for _ in range(3):
            own = _far(s, p).argmin(1) if n else np.zeros(0, int)
            p = np.stack([s[own == i].mean(0) if (own == i).any() else p[i] for i in range(len(p))]) if n else p
        d = np.concatenate([_far(x[i : i + CHUNK] - self.centre, p) for i in range(0, n, CHUNK)]) if n else np.zeros((0, 0))
        own = d.argmin(1) if n else np.zeros(0, int)
        self.order = np.lexsort((d[np.arange(n), own], own))
        own = own[self.order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        self.starts = np.concatenate([np.arange(a, b, ROWS) for a, b in zip(first, np.append(first[1:], n))]) if n else np.zeros(0, int)
        self.ends = np.append(self.starts[1:], n) if n else self.starts
        self.pivot, self.pivots, self.x = own[self.starts], p, x[self.order]
        # least and largest distance of each block's rows to each pivot
        self.lo, self.hi = (f.reduceat(d[self.order], self.starts) if n else d for f in (np.minimum, np.maximum))

    def arrange(self, block: int, at: np.ndarray) -> None:
        """Another order of a block's rows."""
        lo, hi = self.starts[block], self.ends[block]
        self.x[lo:hi], self.order[lo:hi] = self.x[lo:hi][at], self.order[lo:hi][at]


class Search:
    """Blocks of ``cells`` in single precision, unless ``wide``; made once a task."""

    def __init__(self, cells: Cells, wide: bool = False):
        self.c, self.kind = cells, np.float64 if wide else np.float32
        self.y = np.empty((len(cells.x), cells.x.shape[1] + 1), self.kind)
        self.most = 0.0
        for i in range(0, len(cells.x), CHUNK):
            y = cells.x[i : i + CHUNK] - cells.centre
            yy = (y * y).sum(1)
            self.y[i : i + CHUNK, :-1], self.y[i : i + CHUNK, -1] = y, -yy / 2
            self.most = max(self.most, yy.max())

    def set(self, q: np.ndarray) -> None:
        """The rows to compare."""
        z = q - self.c.centre
        self.q, self.zz = q, (z * z).sum(1)
        self.z = np.concatenate([z, np.ones((len(z), 1))], axis=1).astype(self.kind)
        self.d = _far(z, self.c.pivots)
        self.own = self.d.argmin(1)
        self.mine = self.d[np.arange(len(q)), self.own]
        scale = self.most + self.zz.max(initial=0)
        self.error = (q.shape[1] + 8) * 2.0 * float(np.finfo(self.kind).eps) * scale  # of squared distances
        self.slack = 2e-6 * np.sqrt(scale)  # of distances to pivots

    def near(self, block: int, at: np.ndarray, limit) -> np.ndarray:
        """Those of the rows ``at`` for which a row of the block may lie within ``limit``."""
        c = self.c
        p, own = self.d[at, c.pivot[block]], self.own[at]
        low = np.maximum(p - c.hi[block, c.pivot[block]], c.lo[block, c.pivot[block]] - p)
        low = np.maximum(low, np.maximum(c.lo[block, own] - self.mine[at], self.mine[at] - c.hi[block, own]))
        return at[low - self.slack <= limit]

    def visits(self):
        """(block, rows), the blocks of a row's own pivot before the others."""
        c, n = self.c, np.arange(len(self.q))
        for own in (True, False):
            for b in range(len(c.starts)):
                at = n[(self.own == c.pivot[b]) == own]
                if len(at):
                    yield b, at

    def _exact(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for i in range(0, len(rows), PAIRS):
            e = self.q[rows[i : i + PAIRS]] - self.c.x[cols[i : i + PAIRS]]
            out[i : i + PAIRS] = np.sqrt((e * e).sum(1))
        return out

    def nearest(self) -> np.ndarray:
        """The distance of each row to the nearest row of the cells; infinite if there is none."""
        best = np.full(len(self.q), np.inf)
        for b, at in self.visits():
            at = self.near(b, at, best[at])
            lo, y = self.c.starts[b], self.y[self.c.starts[b] : self.c.ends[b]]
            for i in range(0, len(at), CHUNK):
                part = at[i : i + CHUNK]
                g = self.z[part] @ y.T  # half of (|z|^2 - squared distance)
                least = self.zz[part] - 2.0 * g.max(1)
                on = np.flatnonzero(least <= best[part] ** 2 + self.error)
                if not len(on):
                    continue
                cut = np.minimum(best[part[on]] ** 2, least[on] + self.error) + self.error
                # rounded down in single precision, so that none is lost
                r, k = np.nonzero(g[on] >= np.nextafter(((self.zz[part[on]] - cut) / 2).astype(self.kind), -np.inf, dtype=self.kind)[:, None])
                np.minimum.at(best, part[on[r]], self._exact(part[on[r]], lo + k))
        return best

    def within(self, block: int, at: np.ndarray, eps: float):
        """(rows, hits) for pieces of the rows ``at`` that have a hit: ``hits`` says which rows of the block are within ``eps``."""
        lo, y = self.c.starts[block], self.y[self.c.starts[block] : self.c.ends[block]]
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            g = self.z[part] @ y.T
            on = np.flatnonzero(self.zz[part] - 2.0 * g.max(1) <= eps * eps + self.error)
            if not len(on):
                continue
            part, d = part[on], self.zz[part[on], None] - 2.0 * g[on]
            hits = d <= eps * eps - self.error
            r, k = np.nonzero((d <= eps * eps + self.error) & ~hits)
            hits[r, k] = self._exact(part[r], lo + k) <= eps
            some = hits.any(1)
            if some.any():
                yield part[some], hits[some]
