"""A stated query set against all rows: both sides in blocks, one task per pair of blocks, then the best of each query."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block.
QUERY_ROWS = 2048
#: Blocks whose answers to one query are merged in one step.
MERGED = 256
HITS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, key: str, vector: str, zero: bool = False) -> DataFrame:
    """``id long, vector array<double>``: rows with a key whose vector is neither null nor empty and whose
    components are all finite; without ``zero`` not all 0. Vectors of several widths raise an error."""
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        sound = sound & F.exists("vector", lambda x: x != 0)
    return rows.filter(F.coalesce(sound, F.lit(False)))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best_of_blocks(
    base: DataFrame,
    queries: DataFrame,
    search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int,
    block_rows: int,
    query_rows: int = QUERY_ROWS,
    hits_schema: str = HITS,
) -> DataFrame:
    """The ``k`` best hits per query: ``query_id, rank, vec_id, score``, highest score first, then smaller id.

    ``search(ids, vectors, query_ids, queries)`` answers a block of queries from a block of the base with
    arrays of query ids, ids and scores. Block numbers come from hashes, so blocks of any data are alike in
    size; their numbers grow with the tables. A row of the base is sent once per block of queries.
    """
    rows, asked = base.count(), queries.count()
    blocks, parts = max(1, math.ceil(rows / block_rows)), max(1, math.ceil(asked / query_rows))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(parts)).cast("int")
    left = base.select(own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "vector")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"), "id", "vector")

    def answer(stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if stored.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        stored, wanted = stored.sort_values("id", kind="stable"), wanted.sort_values("id", kind="stable")
        vectors, asked_vectors = matrix(stored["vector"]), matrix(wanted["vector"])
        if vectors.shape[1] != asked_vectors.shape[1]:
            raise ValueError("vectors of several widths")
        found = search(stored["id"].to_numpy(np.int64), vectors, wanted["id"].to_numpy(np.int64), asked_vectors)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    hits = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(answer, hits_schema)
    order = [F.col("score").desc(), F.col("vec_id")]
    if blocks > MERGED:
        group = F.pmod(F.xxhash64("query_id", "vec_id"), F.lit(math.ceil(blocks / MERGED)))
        near = Window.partitionBy("query_id", "merged").orderBy(*order)
        hits = hits.withColumn("merged", group).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).drop("rank", "merged")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The ``k`` best (score, smaller id) pairs met so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0)

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -math.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.least
        if not keep.any():
            return
        ids, scores = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.scores, scores[keep]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


class WholeBest:
    """The same for scores that are whole numbers of any size."""

    def __init__(self, k: int):
        self.k, self.pairs = k, []

    @property
    def least(self) -> float:
        return float(-self.pairs[-1][0]) if len(self.pairs) == self.k else -math.inf

    def add(self, ids: list[int], scores: list[int]) -> None:
        self.pairs = sorted([*self.pairs, *((-s, i) for s, i in zip(scores, ids, strict=True))])[: self.k]

    @property
    def ids(self) -> np.ndarray:
        return np.array([i for _, i in self.pairs], np.int64)

    @property
    def scores(self) -> np.ndarray:
        """Scores beyond 64 bits raise an error."""
        return np.array([-s for s, _ in self.pairs], np.int64)
