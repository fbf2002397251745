"""Exact top-k search by tiles.

Queries and candidates are dealt into a grid: ``tile`` candidates by ``tile``
queries per cell, so a cell is one bounded matrix product whatever the sizes
of the two sides, and both sides are copied only once per row or column of the
grid. A cell keeps the best k per query (partial selection); a tree of top-k
steps then merges the cells of a query, ``FAN`` at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 8192
FAN = 64
_SUB = 1024
_CELL = "cell_q int, cell_v int"
_FOUND = "query_id long, vec_id long, score long, node int"


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double; null where a component is null or not finite.

    The values are kept as doubles, which hold whole numbers exactly.
    """
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    return F.when(embedding.isNotNull() & ~bad, whole)


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles while every partial sum is below 2**53, else whole numbers of any size."""
    width = max(1, queries.shape[1])
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * width
    if most < 2.0**53:
        return queries @ vectors.T
    if most < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    whole = [[int(x) for x in row] for row in queries]
    exact = np.array(whole, object).reshape(queries.shape) @ np.array([[int(x) for x in r] for r in vectors], object).reshape(vectors.shape).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_of_tile(found: np.ndarray, vec_ids: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores per row, ties to the smaller id; ``vec_ids`` is ascending.

    A candidate with the query's own id is left out.
    """
    own = vec_ids[None, :] == query_ids[:, None]
    keep = min(len(vec_ids), k + int(own.sum(axis=1).max(initial=0)))
    least = np.partition(found, found.shape[1] - keep, axis=1)[:, found.shape[1] - keep]
    rows, cols = np.nonzero((found >= least[:, None]) & ~own)
    order = np.lexsort((cols, -found[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return rows[place < k], cols[place < k]


def _cell(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            for width in sorted(set(queries["q_dim"]) & set(vectors["dim"])):
                q, v = queries[queries["q_dim"] == width], vectors[vectors["dim"] == width].sort_values("vec_id")
                ids, points = v["vec_id"].to_numpy(), np.array(v["x"].tolist(), np.float64).reshape(len(v), width)
                asked, vectors_q = q["query_id"].to_numpy(), np.array(q["q"].tolist(), np.float64).reshape(len(q), width)
                for a in range(0, len(asked), _SUB):
                    parts = []
                    for b in range(0, len(ids), 4 * _SUB):
                        s = scores(vectors_q[a : a + _SUB], points[b : b + 4 * _SUB])
                        r, c = best_of_tile(s, ids[b : b + 4 * _SUB], asked[a : a + _SUB], k)
                        parts.append(pd.DataFrame({"query_id": asked[a : a + _SUB][r], "vec_id": ids[b : b + 4 * _SUB][c], "score": s[r, c].astype(np.int64)}))
                    near = pd.concat(parts).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                    out.append(near.groupby("query_id", sort=False).head(k))
        if not out:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score", "node")})
        return pd.concat(out).assign(node=int(vectors["cell_v"].iloc[0]))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, tile: int = TILE) -> DataFrame:
    """The k nearest rows of ``vectors`` (vec_id, embedding) for each row of ``queries`` by integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id; a query never finds its own vec_id. Rows whose id or vector is
    null, or whose vector holds a null or a non-finite component, take no part.
    Vectors meet only vectors of their own width. A candidate that is stored
    twice is found twice; of several queries with one id, the least vector
    asks. Scores beyond a long are cut to its range. Other columns are ignored.
    """
    ready = lambda df: df.select("vec_id", quantised(F.col("embedding")).alias("x")).where("vec_id is not null and x is not null")
    asked = ready(queries).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    asked = asked.groupBy("query_id").agg(F.min("q").alias("q")).withColumn("q_dim", F.size("q"))
    points = ready(vectors).withColumn("dim", F.size("x"))
    n_points, n_asked = vectors.count(), queries.count()
    down, across = max(1, math.ceil(n_asked / tile)), max(1, math.ceil(n_points / tile))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("cell_q", at("query_id", down)).withColumn("cell_v", every(across))
    right = points.withColumn("cell_v", at("vec_id", across)).withColumn("cell_q", every(down))
    found = left.groupBy("cell_q", "cell_v").cogroup(right.groupBy("cell_q", "cell_v")).applyInPandas(_cell(k), _FOUND)
    order = [F.col("score").desc(), F.col("vec_id")]
    nodes = across
    while nodes > 1:
        found = found.withColumn("node", F.floor(F.col("node") / FAN).cast("int"))
        place = F.row_number().over(Window.partitionBy("query_id", "node").orderBy(*order))
        found = found.withColumn("place", place).where(F.col("place") <= k).drop("place")
        nodes = math.ceil(nodes / FAN)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score")
