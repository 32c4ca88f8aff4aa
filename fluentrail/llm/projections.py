"""Approximate nearest neighbours: few stable projections in kd-trees, verified until a chi-square test holds."""

from __future__ import annotations

import math
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.blocks import Best, best_of_blocks, usable

#: Projected dimensions, bytes of the vectors of a tree, rows of a leaf, and queries that a task answers from a tree.
DIMENSIONS, TREE_BYTES, LEAF, QUERY_ROWS = 24, 1 << 25, 1024, 1024
#: Chance with which a neighbour nearer than the worst one held lies within the searched projected radius.
SURE = 0.9
SEED = 5


def chi_square_quantile(p: float, dimensions: int) -> float:
    """The value below which a chi-square variable of an even number of dimensions stays with chance ``p``."""

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, dimensions // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@dataclass
class Box:
    """A region of projected rows: its sides, where its rows begin and end, and two halves unless it is a leaf."""

    low: np.ndarray
    high: np.ndarray
    begin: int
    end: int
    halves: tuple[Box, Box] | None


class ProjectionTree:
    """Rows by few random projections with normal weights, which keep distances up to a chi-square factor.

    Rows get one more component that makes all equally long, so that the largest inner product is the
    smallest distance.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dimensions: int = DIMENSIONS, sure: float = SURE):
        if dimensions % 2:
            raise ValueError("an even number of dimensions is needed")
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.length2 = float(norms.max(initial=0.0))
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(self.length2 - norms, 0))[:, None]], 1)
        self.weights = np.random.default_rng(SEED).standard_normal((lifted.shape[1], dimensions))
        projected = lifted @ self.weights
        self.factor = chi_square_quantile(sure, dimensions)
        order: list[np.ndarray] = []
        self.root = self._box(projected, np.arange(len(ids)), 0, order)
        # the rows of a leaf lie side by side
        rows = np.concatenate(order)
        self.rows, self.ids, self.vectors, self.projected = rows, ids[rows], vectors[rows], projected[rows]
        self.spread = np.einsum("ij,ij->i", self.projected, self.projected)
        self.verified = 0

    def _box(self, projected: np.ndarray, rows: np.ndarray, begin: int, order: list[np.ndarray]) -> Box:
        points = projected[rows]
        low, high = points.min(0), points.max(0)
        halves = None
        if len(rows) <= LEAF or (high == low).all():
            order.append(rows)
        else:
            sides = rows[np.argsort(points[:, int(np.argmax(high - low))], kind="stable")]
            half = len(sides) // 2
            halves = (self._box(projected, sides[:half], begin, order), self._box(projected, sides[half:], begin + half, order))
        return Box(low, high, begin, begin + len(rows), halves)

    def search(self, query: np.ndarray, k: int, own: int | None = None) -> Best:
        """The numbers of the best rows, looked for by projected distance until what is left is improbable to be among them.

        Leaves come in order of their distance. Of a leaf only the rows are verified that lie within the radius of
        the stopping test; the radius only shrinks, so the others would not come up before the test holds.
        """
        best = Best(k)
        base = float(query @ query) + self.length2
        point = query @ self.weights[:-1]
        span = float(point @ point)

        def away(box: Box) -> float:
            gap = np.maximum(np.maximum(box.low - point, point - box.high), 0)
            return float(gap @ gap)

        agenda, turn = [(away(self.root), 0, self.root)], 0
        while agenda:
            near, _, box = heappop(agenda)
            # projected distance² / distance² is chi-square: farther out lies a better row with chance 1 - SURE at most
            radius = self.factor * max(base - 2 * best.least, 0)
            if near > radius:
                break
            if box.halves is None:
                own_rows = slice(box.begin, box.end)
                wanted = self.ids[own_rows] != own
                if radius < math.inf:
                    # the squared projected distance, for which rounding leaves some room
                    gaps = self.spread[own_rows] - 2 * (self.projected[own_rows] @ point) + span
                    wanted &= gaps <= radius * (1 + 1e-9) + 1e-12 * span
                rows = box.begin + np.flatnonzero(wanted)
                self.verified += len(rows)
                best.add(self.rows[rows], self.vectors[rows] @ query)
            else:
                for half in box.halves:
                    turn += 1
                    heappush(agenda, (away(half), turn, half))
        return best


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", sure: float = SURE, tree_rows: int | None = None) -> DataFrame:
    """About the ``k`` rows of largest inner product per query, itself left out: ``query_id, rank, vec_id, score``.

    Every row is in a tree and every tree is asked; a true neighbour is missed in its tree with a chance of at
    most ``1 - sure``. Scores are the correctly rounded sums of products of the original components; ties go to
    the smaller id. Null keys, vectors that are null, empty or zero or hold a null or non-finite component take
    no part. Rows that repeat an id are hits each for itself; those with the id of the query are left out.
    Empty tables give no rows. A tree has ``tree_rows`` rows, by default as many as ``TREE_BYTES`` hold.
    """
    rows = usable(base, key, vector)
    if tree_rows is None:
        widest = rows.agg(F.max(F.size("vector"))).first()[0] or 1
        tree_rows = max(1, TREE_BYTES // (8 * widest))

    def search(ids, vectors, query_ids, wanted):
        tree = ProjectionTree(ids, vectors, sure=sure)
        out_query, out_id, out_score = [], [], []
        listed = vectors.tolist()
        for own, query in zip(query_ids.tolist(), wanted, strict=True):
            best = tree.search(query, k, own)
            values = query.tolist()
            # rows come in order of their ids, so ties went to the smaller one
            exact = [math.sumprod(listed[row], values) for row in best.ids.tolist()]
            out_query.append(np.full(len(best.ids), own))
            out_id.append(ids[best.ids])
            out_score.append(np.asarray(exact, np.float64))
        return np.concatenate(out_query), np.concatenate(out_id), np.concatenate(out_score)

    return best_of_blocks(rows, usable(queries, key, vector), search, k, tree_rows, QUERY_ROWS)
