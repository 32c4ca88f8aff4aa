"""Exact top-k search by inner product: best-first through M-trees."""

from __future__ import annotations

import math
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.blocks import HITS, Best, WholeBest, best_of_blocks, usable

#: Entries of a page.
PAGE = 64
#: Rows of a tree. Trees are built where they are searched.
TREE_ROWS = 1024
#: Bounds are loosened by this share of the largest distance, so that rounding rules out no row.
SLACK = 1e-9


@dataclass
class Node:
    """A page: its entries' places (rows in a leaf, else children), distances to the page's own centre and radii."""

    members: np.ndarray
    to_centre: np.ndarray
    radii: np.ndarray
    children: list[Node] | None
    radius: float


class MTree:
    """Pages of rows around centres, in a space where the nearest row has the largest inner product.

    Each row gets one more component that makes all rows equally long; a query's is 0. There,
    ``distance² = |query|² + length² - 2 · inner product``.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        self.ids, self.vectors, self.page = ids, vectors, page
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.length2 = float(norms.max(initial=0.0))
        self.lifted = np.concatenate([vectors, np.sqrt(np.maximum(self.length2 - norms, 0))[:, None]], 1)
        self.slack = SLACK * (1 + 2 * math.sqrt(self.length2))
        self.centre = 0
        self.root = self._page(np.arange(len(ids)), 0)
        self.computed = 0

    def _distances(self, rows: np.ndarray, centre: int) -> np.ndarray:
        gap = self.lifted[rows] - self.lifted[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _page(self, rows: np.ndarray, centre: int) -> Node:
        to_centre = self._distances(rows, centre)
        radius = float(to_centre.max(initial=0.0))
        if len(rows) <= self.page:
            return Node(rows, to_centre, np.zeros(len(rows)), None, radius)
        # centres far from each other, then each row to its nearest one
        wanted = min(self.page, max(2, math.ceil(len(rows) / (self.page // 2))))
        centres, near = [], np.full(len(rows), np.inf)
        owner, last = np.zeros(len(rows), np.int64), int(np.argmax(to_centre))
        for number in range(wanted):
            away = self._distances(rows, int(rows[last]))
            owner[away < near] = number
            near = np.minimum(near, away)
            centres.append(int(rows[last]))
            last = int(np.argmax(near))
            if near[last] == 0:
                break
        groups = [rows[owner == number] for number in range(len(centres))]
        if max(map(len, groups)) == len(rows):  # equal rows
            groups = np.array_split(rows, wanted)
            centres = [int(group[0]) for group in groups]
        pairs = [(c, g) for c, g in zip(centres, groups, strict=True) if len(g)]
        children = [self._page(group, c) for c, group in pairs]
        at = np.array([c for c, _ in pairs])
        return Node(at, self._distances(at, centre), np.array([child.radius for child in children]), children, radius)

    def search(self, query: np.ndarray, k: int, own: int | None = None, whole: bool = False) -> Best | WholeBest:
        """The ``k`` rows with the largest inner products, the row whose id is ``own`` left out.

        If all components are ``whole`` numbers, so are the scores: rows that may be among the best, whatever rounding did to their
        product, are worked out once more in integers.
        """
        best = WholeBest(k) if whole else Best(k)
        base = float(query @ query) + self.length2
        asked = [int(x) for x in query.tolist()] if whole else []
        # more than the error of a product of rounded sums
        error = 4 * len(query) * np.finfo(float).eps * math.sqrt(float(query @ query) * self.length2) if whole else 0.0

        def away(rows: np.ndarray) -> np.ndarray:
            self.computed += len(rows)
            return np.sqrt(np.maximum(base - 2 * (self.vectors[rows] @ query), 0))

        def limit() -> float:
            return math.inf if best.least == -math.inf else math.sqrt(max(base - 2 * (best.least - error), 0)) + self.slack

        # (least possible distance, turn, distance of the page's centre, page)
        agenda = [(0.0, 0, float(away(np.array([self.centre]))[0]), self.root)]
        turn = 0
        while agenda:
            least, _, centre_away, node = heappop(agenda)
            bound = limit()
            if least > bound:
                break
            # by the triangle inequality, without a new distance
            open_entries = np.abs(centre_away - node.to_centre) - node.radii <= bound
            members = node.members[open_entries]
            if not len(members):
                continue
            if node.children is None:
                self.computed += len(members)
                scores = self.vectors[members] @ query
                ids = self.ids[members]
                others = ids != own
                if whole:
                    near = others & (scores >= best.least - error)
                    products = [math.sumprod([int(x) for x in row], asked) for row in self.vectors[members[near]].tolist()]
                    best.add(ids[near].tolist(), products)
                else:
                    best.add(ids[others], scores[others])
                continue
            distances = away(members)
            for place, distance in zip(np.flatnonzero(open_entries).tolist(), distances.tolist(), strict=True):
                possible = max(distance - node.radii[place], 0.0)
                if possible <= bound:
                    turn += 1
                    heappush(agenda, (possible, turn, distance, node.children[place]))
        return best


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float | None = None, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Exactly the ``k`` rows of largest inner product per query, itself left out: ``query_id, rank, vec_id, score``.

    With ``scale`` each component x counts as floor(scale * x), and scores are exact whole numbers, of 64 bits at most; larger ones raise an error. Ties go to the
    smaller id. Null keys and vectors that are null, empty or hold a null or non-finite component take no part,
    a query without candidates has no rows; empty tables give none. Rows that repeat an id are hits each
    for itself; those with the id of the query are left out.
    """

    def ready(df: DataFrame) -> DataFrame:
        rows = usable(df, key, vector, zero=True)
        if scale is not None:
            rows = rows.select("id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"))
        return rows

    def search(ids, vectors, query_ids, wanted):
        tree = MTree(ids, vectors)
        found = [tree.search(query, k, own, scale is not None) for own, query in zip(query_ids.tolist(), wanted, strict=True)]
        return np.repeat(query_ids, [len(b.ids) for b in found]), np.concatenate([b.ids for b in found]), np.concatenate([b.scores for b in found])

    hits = HITS if scale is None else HITS.replace("score double", "score long")
    return best_of_blocks(ready(base), ready(queries), search, k, tree_rows, hits_schema=hits)
