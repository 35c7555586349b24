"""Compressed vector codes: coarse cells, and one byte per segment of what a cell leaves over.

A codebook is fitted on a bounded sample. Distances to what the codes stand for
only choose candidates, which exact distances rank afterwards. How many cells a query looks into and
how many candidates it keeps is measured on the sample: enough for ``REACH`` of the sample's own
neighbours, however the vectors are spread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 12
BYTE = 256
SEGMENT = 4
MAX_SEGMENTS = 64
MAX_CELLS = 4096
ROWS_PER_CELL = 24
JUDGED = 256
REACH = 0.98
SLAB = 2048


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b**2).sum(axis=1)[None, :], 0.0)


def nearest_center(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    found = [squared_distances(rows[i : i + SLAB], centers).argmin(axis=1) for i in range(0, len(rows), SLAB)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def centers_of(rows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` centres by Lloyd's rounds from distinct rows; a centre without rows takes one drawn anew."""
    first = {row.tobytes(): i for i, row in reversed(list(enumerate(rows)))}
    distinct = rows[sorted(first.values())]
    if len(distinct) <= n:
        return distinct
    centers = distinct[rng.choice(len(distinct), n, replace=False)]
    for _ in range(ROUNDS):
        own = nearest_center(rows, centers)
        counts = np.bincount(own, minlength=n)
        sums = np.stack([np.bincount(own, weights=column, minlength=n) for column in rows.T], axis=1)
        filled = counts > 0
        centers = np.where(filled[:, None], sums / np.maximum(counts, 1)[:, None], centers)
        centers[~filled] = distinct[rng.choice(len(distinct), int((~filled).sum()))]
    return centers


@dataclass
class Codebook:
    """Cells (C x d), and per segment its bounds and its centres of residuals."""

    cells: np.ndarray
    bounds: list[int]
    books: list[np.ndarray]
    probes: int = 1
    refine: int = 1

    @classmethod
    def fit(cls, sample: np.ndarray, n_rows: int, k: int, seed: int) -> Codebook:
        rng = np.random.default_rng(seed)
        n_cells = max(1, min(int(n_rows**0.5), len(sample) // ROWS_PER_CELL, MAX_CELLS))
        cells = centers_of(sample, n_cells, rng)
        left = sample - cells[nearest_center(sample, cells)]
        dim = sample.shape[1]
        n_segments = max(1, min(-(-dim // SEGMENT), MAX_SEGMENTS))
        bounds = [round(i * dim / n_segments) for i in range(n_segments + 1)]
        books = [centers_of(left[:, a:b], BYTE, rng) for a, b in zip(bounds, bounds[1:], strict=False)]
        out = cls(cells, bounds, books)
        out._judge(sample, n_rows, k, rng)
        return out

    def _judge(self, sample: np.ndarray, n_rows: int, k: int, rng: np.random.Generator) -> None:
        """Set probes and refine so that ``REACH`` of the sample's nearest rows are reached."""
        asked = rng.choice(len(sample), min(JUDGED, len(sample)), replace=False)
        own, codes = self.encode(sample)
        exact = squared_distances(sample[asked], sample)
        exact[np.arange(len(asked)), asked] = np.inf
        wanted = np.argsort(exact, axis=1)[:, : min(k, len(sample) - 1)]
        order = np.argsort(squared_distances(sample[asked], self.cells), axis=1)
        rank_of_cell = np.argsort(order, axis=1)
        cell_ranks = np.take_along_axis(rank_of_cell, own[wanted], axis=1)
        self.probes = int(np.quantile(cell_ranks, REACH, method="higher")) + 1 if wanted.size else len(self.cells)
        far = squared_distances(sample[asked], self.decode(own, codes))
        far[np.arange(len(asked)), asked] = np.inf
        ranks = np.take_along_axis(np.argsort(np.argsort(far, axis=1), axis=1), wanted, axis=1)
        seen = int(np.quantile(ranks, REACH, method="higher")) + 1 if ranks.size else 1
        self.refine = max(2 * seen, 4 * k)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its code (rows x segments, bytes)."""
        own = nearest_center(rows, self.cells)
        left = rows - self.cells[own]
        codes = [nearest_center(left[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.books, strict=False)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def cells_to_probe(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(squared_distances(queries, self.cells), axis=1, kind="stable")[:, : self.probes]

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for: centre of the cell plus the centres of the segments."""
        parts = [book[codes[:, k]] for k, book in enumerate(self.books)]
        return self.cells[own] + np.concatenate(parts, axis=1)
