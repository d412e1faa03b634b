"""Best partners among two sets of vectors that meet inside one task.

Products are taken in single precision, tile by tile, and only pairs that may reach the
k-th similarity of one of their rows, less the largest rounding error, are multiplied
again in double precision: what is listed is as exact as if all had been. Each pair is
multiplied once and offered both ways. The k-th similarity rises as partners are found,
so few pairs pass. Rows of near copies whose products differ by less than a single
precision tells are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows and columns of a tile; its products stay in the cache of a core.
TILE_ROWS, TILE_COLS = 256, 2048
#: Columns of a tile whose largest product is taken.
STRIP = 256
#: Partners found before they are ranked, and numbers of them that are multiplied at a time.
PENDING = 4096
EXACT_VALUES = 1 << 21
#: Partners a row and tile, on average, above which single precision does not tell them apart.
CROWDED = 64


class Side:
    """Vectors with ids, sorted by cell, and the ``k`` best partners found of each so far.

    ``kth`` has the similarity below which a row wants no partner. Vectors with a number
    that is not finite have no partners.
    """

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, cells: np.ndarray, kth: np.ndarray, k: int):
        self.ids, self.vecs, self.cells, self.kth, self.k = ids, vecs, cells, kth, k
        self.starts = np.searchsorted(cells, np.arange(cells[-1] + 2 if len(cells) else 1))
        self.sims = np.full((len(ids), k), -np.inf)
        self.partners = np.zeros((len(ids), k), dtype=np.int64)
        self.pending, self.held = [], 0

    def scaled(self, scale: float) -> None:
        """Single precision rows of length 1 at most, and what a product of theirs may be off by."""
        self.rank()
        self.scale, self.seeded = scale, np.isfinite(self.kth)
        self.rough = (self.vecs / scale).astype(np.float32)
        length = np.sqrt(np.einsum("ij,ij->i", self.rough, self.rough, dtype=np.float64))
        self.margin = (self.vecs.shape[1] + 16) * 2.0**-23 * length + 1e-30
        self.least = (self.kth / scale / scale - self.margin).astype(np.float32)

    def offer(self, rows: np.ndarray, other: Side, others: np.ndarray) -> None:
        step = max(1, EXACT_VALUES // max(1, self.vecs.shape[1]))
        for at in range(0, len(rows), step):
            r, o = rows[at : at + step], others[at : at + step]
            sims = np.einsum("ij,ij->i", self.vecs[r], other.vecs[o])
            ids = other.ids[o]
            good = (ids != self.ids[r]) & np.isfinite(sims) & (sims >= self.kth[r])
            self.pending.append((r[good], ids[good], sims[good]))
            self.held += int(good.sum())
            if self.held > PENDING:
                self.rank()

    def rank(self) -> None:
        """The pending partners are merged with the best so far: score first, then lowest id."""
        if not self.held:
            return
        rows, ids, sims = (np.concatenate(x) for x in zip(*self.pending))
        self.pending, self.held = [], 0
        touched, at = np.unique(rows, return_inverse=True)
        at = np.concatenate([at, np.repeat(np.arange(len(touched)), self.k)])
        ids = np.concatenate([ids, self.partners[touched].ravel()])
        sims = np.concatenate([sims, self.sims[touched].ravel()])
        order = np.lexsort((ids, -sims, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        order, at, place = (x[place < self.k] for x in (order, at, place))
        self.sims[touched[at], place] = sims[order]
        self.partners[touched[at], place] = ids[order]
        self.kth[touched] = np.maximum(self.kth[touched], self.sims[touched, self.k - 1])
        least = self.kth[touched] / self.scale / self.scale - self.margin[touched]
        self.least[touched] = np.maximum(self.least[touched], least.astype(np.float32))

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, partner, similarity) of what was found."""
        self.rank()
        rows, places = np.nonzero(np.isfinite(self.sims))
        return self.ids[rows], self.partners[rows, places], self.sims[rows, places]


def side(ids: np.ndarray, vecs: np.ndarray, cells: np.ndarray, kth: np.ndarray, k: int) -> Side:
    good = np.isfinite(vecs).all(axis=1)
    return Side(ids[good], vecs[good], cells[good], kth[good], k)


def _longest(vecs: np.ndarray) -> float:
    most = np.abs(vecs).max(initial=0.0)
    return most * np.linalg.norm(vecs / most, axis=1).max() if most > 0 else 0.0


def _kth_product(products: np.ndarray, own: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest product of each row with others of another id."""
    if products.shape[1] < k:
        return np.full(len(products), -np.inf)
    products = np.where(own[:, None] == other[None, :], -np.inf, products)
    return np.partition(products, products.shape[1] - k, axis=1)[:, -k]


def _reaching(products: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the products that are not less than ``least`` of their row.

    Looked for one by one only in strips whose largest product reaches it.
    """
    found = []
    whole = products.shape[1] - products.shape[1] % STRIP
    for first, end, wide in ((0, whole, STRIP), (whole, products.shape[1], products.shape[1] - whole)):
        if first < end:
            strips = products[:, first:end].reshape(len(products), -1, wide)
            rows, places = np.nonzero(strips.max(axis=2) >= least[:, None])
            at, cols = np.nonzero(strips[rows, places] >= least[rows, None])
            found.append((rows[at], first + places[at] * wide + cols))
    return tuple(np.concatenate(x) for x in zip(*found))


def _one_way(a: Side, start: int, stop: int, b: Side, left: int, right: int, products: np.ndarray) -> None:
    """Rows ``start`` to ``stop`` of ``a`` are offered those of ``b`` whose products with them are large enough."""
    fresh = start + np.flatnonzero(~a.seeded[start:stop])
    if len(fresh) and right - left > a.k:
        kth = _kth_product(products[fresh - start], a.ids[fresh], b.ids[left:right], a.k)
        a.least[fresh] = np.maximum(a.least[fresh], (kth - 2 * a.margin[fresh]).astype(np.float32))
        a.seeded[fresh] = np.isfinite(kth)
    rows, cols = _reaching(products, a.least[start:stop])
    if len(rows) > CROWDED * (stop - start):
        a.rank()
        fine = (a.vecs[start:stop] / a.scale) @ (b.vecs[left:right] / b.scale).T
        margin = a.margin[start:stop] * 2.0**-28
        kth = np.maximum(a.kth[start:stop] / a.scale / a.scale, _kth_product(fine, a.ids[start:stop], b.ids[left:right], a.k) - margin)
        rows, cols = _reaching(fine, kth - margin)
    if len(rows):
        a.offer(start + rows, b, left + cols)


def _stretches(wanted: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, end) of the rows of wanted cells that lie side by side."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], wanted, [False]]).astype(np.int8)))
    for first, end in edges.reshape(-1, 2):
        yield int(starts[first]), int(starts[end])


def meet(a: Side, b: Side, wanted: np.ndarray | None = None) -> None:
    """Every row meets the rows of the other side, or of its own if ``a is b``, each pair once.

    ``wanted`` (cells of ``a`` by cells of ``b``) names the cells that need to meet.
    """
    if not len(a.ids) or not len(b.ids):
        return
    scale = max(_longest(a.vecs), _longest(b.vecs))
    for x in (a, b):
        x.scaled(scale if 0 < scale < np.inf else 1.0)
    tile = np.empty(TILE_ROWS * TILE_COLS, dtype=np.float32)
    for start in range(0, len(a.ids), TILE_ROWS):
        stop = min(start + TILE_ROWS, len(a.ids))
        stretches = [(0, len(b.ids))]
        if wanted is not None:
            stretches = _stretches(wanted[a.cells[start] : a.cells[stop - 1] + 1].any(axis=0), b.starts)
        own = [(start, stop)] if a is b else []
        others = [(max(first, stop) if a is b else first, end) for first, end in stretches]
        for first, end in own + others:
            for left in range(first, end, TILE_COLS):
                right = min(left + TILE_COLS, end)
                products = tile[: (stop - start) * (right - left)].reshape(stop - start, -1)
                np.matmul(a.rough[start:stop], b.rough[left:right].T, out=products)
                _one_way(a, start, stop, b, left, right, products)
                if a is not b or left >= stop:
                    _one_way(b, left, right, a, start, stop, products.T)
