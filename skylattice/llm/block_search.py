"""Nearest neighbours by a block matrix join over int8 tiles.

Each block is quantised to int8 with one scale; the length of what a vector loses is kept. The product of two int8 tiles
gives every distance of the quantised vectors, and the true distance differs from it by no more than the two losses
together. Pairs whose lower bound is within the k-th smallest upper bound survive, are recomputed from the original
vectors in double precision, some at a time, and go through a heap for each query. The bounds hold for any vectors, so
nothing of the true answer is lost within a block.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.vector_blocks import QUERIES, ROWS, asked_columns, best_of_blocks, grid, numbered, pack, queries_of, ranked, small_vector_batches, valid_vectors, with_index

#: Surviving pairs that are recomputed at once.
SLICE = 65_536


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 tile, scale, and the length of each vector's loss."""
    scale = float(np.abs(x).max(initial=0)) / 127 or 1.0
    tile = np.rint(x / scale).astype(np.int8)
    return tile, scale, np.sqrt(((x - tile * scale) ** 2).sum(1))


def tile_distances(a: np.ndarray, sa: float, b: np.ndarray, sb: float) -> np.ndarray:
    """Distances of quantised vectors. Products of int8 are summed in single precision, exact below 2^24, in slices of
    the dimension that stay below it."""
    dot = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], 1024):
        dot += a[:, lo : lo + 1024].astype(np.float32) @ b[:, lo : lo + 1024].astype(np.float32).T
    na, nb = (a.astype(np.float64) ** 2).sum(1), (b.astype(np.float64) ** 2).sum(1)
    return np.sqrt(np.maximum(0, sa * sa * na[:, None] + sb * sb * nb[None, :] - 2 * sa * sb * dot))


def true_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of the rows in pairs, squares added from the first component to the last."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = q[:, j] - x[:, j]
        total += d * d
    return np.sqrt(total)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    (tq, sq, eq), (tx, sx, ex) = quantise(q), quantise(x)
    d = tile_distances(tq, sq, tx, sx)
    loss = eq[:, None] + ex[None, :]
    slack = 1e-9 * (1 + d + loss)
    own = q_ids[:, None] == ids[None, :]
    upper = np.where(own, np.inf, d + loss + slack)
    most = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(q), np.inf)
    at, j = np.nonzero((d - loss - slack <= most[:, None]) & ~own)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
    for lo in range(0, len(at), SLICE):
        some, other = at[lo : lo + SLICE], j[lo : lo + SLICE]
        for i, s, v in zip(some.tolist(), true_distances(q[some], x[other]).tolist(), ids[other].tolist(), strict=True):
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], (-s, -v))
            else:
                heapq.heappushpop(heaps[i], (-s, -v))
    rows = [(i, -v, -s) for i, h in enumerate(heaps) for s, v in h]
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def nearest(spark: SparkSession, df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k nearest other rows by
    Euclidean distance, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors meet only those of
    their own length. Of rows repeated with one id the smallest vector asks, and each is a candidate of other ids' rows.
    With fewer than k candidates all are returned; an empty table gives an empty result; other columns aren't read.
    """
    small_vector_batches(spark)
    base = valid_vectors(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    plain = lambda x: (np.zeros(len(x), np.int32), np.zeros(len(x)))
    data = pack(spark, with_index(base, plain), ROWS, base.count())
    queries = queries_of(base, every)
    asked = numbered(spark, pack(spark, with_index(queries, plain), QUERIES, queries.count()))
    # every query block meets every block of its length: a unit is a range of vectors of one length
    data = data.withColumn("unit", F.struct(F.shiftright("block", 32).alias("range"), "dim"))
    units = data.groupBy("unit").agg(F.count("*").alias("blocks"))  # RANGES rows and as many as there are lengths
    pairs = asked.select(F.col("block").alias("q"), "dim").join(F.broadcast(units), F.col("dim") == F.col("unit.dim")).select("unit", "q", F.lit(0).alias("first"), "blocks")

    def kernel(q_ids, q, _, __, ids, x, ___, k):
        return search_block(q_ids, q, ids, x, k)

    return ranked(best_of_blocks(grid(pairs, data, asked_columns(asked)), k, "double", kernel), k, F.asc)


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 10
"""
