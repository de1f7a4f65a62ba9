"""Whitening of embeddings by merging singular value decompositions up a tree.

Each partition of the distinct vectors keeps what a decomposition of its centred vectors says, whole: how many there are, their
exact sums, all singular values and all right vectors. Two such summaries are merged by stacking their scaled vectors and
one row more, which corrects for the distance of the means, and decomposing again. No dimension is left out on the way,
so the top of the tree has the covariance of all vectors to double precision, without squaring the condition as sums of
products do. A summary's size depends on the dimension alone, and the tree merges FAN of them in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import checkpoint, small_batches

#: Summaries merged in one task, vectors decomposed at once, and the lengths of vectors that a table may hold.
FAN, ROWS, LENGTHS = 8, 4096, 1000
#: A component whose deviation is this small a share of the largest is rounding, not a component.
RANK = 1e-9
#: Values of int64 that products and sums stay below.
SAFE = 1 << 62

SUMMARY = "dim int, node long, n long, sums binary, s binary, vt binary"


@dataclass
class Summary:
    """n vectors with exact sums; s and the rows of vt are all singular values and vectors of the centred vectors."""

    n: int
    sums: np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of the rows of a matrix of whole numbers."""
        if int(np.abs(x).max(initial=0)) * len(x) >= SAFE:
            raise ValueError("entries are too large for exact sums")
        sums = x.sum(axis=0)
        _, s, vt = np.linalg.svd(x - sums / len(x), full_matrices=False)
        return cls(len(x), sums, s, vt)

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = (self.sums / self.n - other.sums / other.n) * np.sqrt(self.n * (other.n / n))
        _, s, vt = np.linalg.svd(np.vstack([self.s[:, None] * self.vt, other.s[:, None] * other.vt, apart[None, :]]), full_matrices=False)
        sums = self.sums + other.sums
        if int(np.abs(sums).max(initial=0)) >= SAFE:
            raise ValueError("entries are too large for exact sums")
        return Summary(n, sums, s, vt)

    def row(self, node: int) -> tuple:
        return len(self.sums), node, self.n, self.sums.astype(np.int64).tobytes(), self.s.tobytes(), self.vt.tobytes()

    @classmethod
    def load(cls, dim: int, n: int, sums: bytes, s: bytes, vt: bytes) -> Summary:
        return cls(int(n), np.frombuffer(sums, np.int64), np.frombuffer(s), np.frombuffer(vt).reshape(-1, int(dim)))


@dataclass
class Model:
    """What whitens vectors of one length: n, exact sums, eigenvalues by falling size, eigenvectors (rows), and shares of the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, top: Summary, most: int) -> Model:
        k = min(most, int((top.s > RANK * top.s[0]).sum()) if len(top.s) and top.s[0] > 0 else 0)
        squares = top.s**2
        return cls(top.n, top.sums, squares[:k] / top.n, top.vt[:k], squares[:k] / squares.sum() if k else np.zeros(0))

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact; Python's whole numbers where 64 bits might not do."""
        if len(x) and int(np.abs(x).max()) * self.n + int(np.abs(self.sums).max(initial=0)) >= SAFE:
            return x.astype(object) * self.n - self.sums.astype(object)
        return x * self.n - self.sums

    def whitened(self, spread: np.ndarray) -> np.ndarray:
        return (spread.astype(np.float64) / self.n) @ self.vectors.T / np.sqrt(self.values)

    @staticmethod
    def deviation(spread: np.ndarray) -> list[int | None]:
        """Sums of squares, exact; none where 64 bits can't hold one."""
        if spread.dtype != object and spread.size and int(np.abs(spread).max()) ** 2 * spread.shape[1] < SAFE:
            return (spread * spread).sum(axis=1).tolist()
        exact = (sum(int(v) * int(v) for v in r) for r in spread)
        return [v if v < 1 << 63 else None for v in exact]


def whole_numbers(df: DataFrame, vec_col: str, scale: int, more: dict[str, Column]) -> DataFrame:
    """Columns `more` and x, floor(scale * entry) of every vector that isn't null or empty and holds only finite numbers."""
    vec = df[vec_col].cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(vec.isNotNull() & (F.size(vec) > 0) & good).select(*[c.alias(n) for n, c in more.items()], F.transform(vec, lambda x: F.floor(x * scale)).alias("x"))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors in a column: which rows, and their matrix."""
    size = np.diff(np.asarray(column.offsets))
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        own = column.take(pa.array(rows))
        at = np.asarray(own.offsets)
        yield rows, own.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64).reshape(len(rows), dim)


def summaries(vectors: DataFrame) -> DataFrame:
    """One summary for each partition and length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                new = Summary.of(x)
                held[x.shape[1]] = held[x.shape[1]].merged(new) if x.shape[1] in held else new
        rows = [s.row(TaskContext.get().partitionId()) for s in held.values()]
        schema = pa.schema([("dim", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("sums", pa.binary()), ("s", pa.binary()), ("vt", pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema, strict=True)], schema=schema)

    return vectors.select("x").mapInArrow(run, SUMMARY)


def merge_tree(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """One summary for each length, from FAN neighbours in each step."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in rows.sort_values("part").itertuples():
            one = Summary.load(r.dim, r.n, r.sums, r.s, r.vt)
            total = one if total is None else total.merged(one)
        return pd.DataFrame([total.row(int(rows["node"].iloc[0]))], columns=["dim", "node", "n", "sums", "s", "vt"])

    parts = checkpoint(spark, parts)
    last = parts.agg(F.max("node")).first()[0] or 0
    while last > 0:
        parts = parts.withColumnRenamed("node", "part").withColumn("node", F.floor(F.col("part") / FAN))
        parts = parts.groupBy("dim", "node").applyInPandas(merge, SUMMARY)
        last //= FAN
    return parts


def fit(spark: SparkSession, vectors: DataFrame, components: int = 16) -> dict[int, Model]:
    """A model for each length of the vectors (column x); every row counts once. What comes to the driver is one summary
    for each length, whose size is that of a square of the dimension."""
    found = merge_tree(spark, summaries(vectors)).limit(LENGTHS + 1).collect()
    if len(found) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} different lengths")
    return {r["dim"]: Model.of(Summary.load(r["dim"], r["n"], r["sums"], r["s"], r["vt"]), components) for r in found}


def identity_error(vectors: DataFrame, models: dict[int, Model]) -> float:
    """The largest entry of whitened vectors' covariance minus the identity, over a second pass of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                m = models[x.shape[1]]
                w = m.whitened(m.spread(x))
                k = w.shape[1]
                i, j = np.divmod(np.arange(k * k), k)
                some = [np.concatenate([np.full(k, -1), i]), np.concatenate([np.arange(k), j]), np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), x.shape[1], np.int32)), pa.array(some[0].astype(np.int32)), pa.array(some[1].astype(np.int32)), pa.array(some[2].astype(np.float64))], ["dim", "i", "j", "s"])

    sums = vectors.select("x").mapInArrow(run, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    worst = 0.0
    found: dict[int, dict[tuple[int, int], float]] = {}
    for r in sums.collect():  # a row for each two components of each length
        found.setdefault(r["dim"], {})[r["i"], r["j"]] = r["s"] / models[r["dim"]].n
    for one in found.values():
        for (i, j), v in one.items():
            if i >= 0:  # the vectors are centred by the sums of all; what rounding leaves of their mean is taken off here
                worst = max(worst, abs(v - one[-1, i] * one[-1, j] - (i == j)))
    return worst


def whiten(spark: SparkSession, df: DataFrame, components: int = 16, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, for each row and component.

    The vectors are whole numbers, floor(scale * entry); an offset common to all entries, such as 1,000,000, changes none of the results.
    A model is fitted to the distinct vectors, each counted once, however often rows repeat one. Rows whose vector is
    null or empty or holds null or non-finite entries go; a null id stays a null id, repeated rows stay rows.
    Vectors of another length have a model of their own. Components that don't exist (fewer vectors or dimensions, or
    all vectors alike) have no rows, so a table with one distinct vector gives none, as an empty table does. A deviation that 64 bits can't hold
    is null. Other columns are left alone, whatever their names.
    """
    small_batches(spark, ROWS)
    rows = whole_numbers(df, vec_col, scale, {"vec_id": df[id_col].cast("long")})
    vectors = checkpoint(spark, rows.select("x").distinct())
    models = fit(spark, vectors, components)
    error = identity_error(vectors, models)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column(1)):
                m = models[x.shape[1]]
                k = len(m.values)
                spread = m.spread(x)
                deviation = pa.array(m.deviation(spread), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * k, m.n, np.int64)),
                        deviation,
                        pa.array(m.whitened(spread).ravel()),
                        pa.array(np.tile(m.explained, len(at))),
                    ],
                    schema=schema,
                )

    out = rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double")
    return out.withColumn("identity_error", F.lit(error))
