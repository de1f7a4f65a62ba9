"""What the two vector searches share: valid vectors, packing into blocks, and the grid join of blocks.

Vectors are sorted into ranges and packed, some ROWS of them to a row (ids, vectors, further numbers), queries likewise.
Wanted pairs of blocks meet in a grid: SIDE blocks of vectors and SIDE blocks of queries come together under one key, so
a block is sent once for every SIDE blocks of the other kind, not for each. A task holds a few blocks at a time,
however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import checkpoint, small_batches

#: Vectors and queries of a block, blocks of a grid key on each side, and ranges that vectors are sorted into at most.
ROWS, QUERIES, SIDE, RANGES = 2048, 512, 16, 4096
PACKED = "block long, place long, dim int, part int, n long, most double, ids binary, kind string, data binary, far binary, low double, high double"
PACKED_SCHEMA = pa.schema(
    [("block", pa.int64()), ("place", pa.int64()), ("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("most", pa.float64()), ("ids", pa.binary()), ("kind", pa.string()), ("data", pa.binary()), ("far", pa.binary()), ("low", pa.float64()), ("high", pa.float64())]
)


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (array of double) of rows that take part: an id, and a vector that isn't empty and holds only
    finite numbers. Rows repeated with one id stay candidates of their own."""
    vec = df[vec_col].cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(df[id_col].cast("long").alias("vec_id"), vec.alias("vec")).where(df[id_col].isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & good)


def queries_of(base: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible; of rows repeated with one id, the smallest vector asks."""
    return base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.Array, lo: int, hi: int, dim: int) -> np.ndarray:
    """The vectors of some rows of a list column, all of one length."""
    at = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False)[at[lo] : at[hi]].astype(np.float64).reshape(hi - lo, dim)


def dump(x: np.ndarray) -> tuple[str, bytes]:
    """As 32-bit numbers where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return ("f4", small.tobytes()) if np.array_equal(small.astype(np.float64), x) else ("f8", x.tobytes())


def load(kind: str, data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.float64).reshape(-1, dim)


def with_index(df: DataFrame, keys: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """vec_id, vec, dim, and part and far (a whole number and a number that vectors are sorted by) from keys(vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(np.asarray(batch.column(1).offsets))
            part, far = np.zeros(len(size), np.int32), np.zeros(len(size))
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                own = batch.column(1).take(pa.array(rows))
                part[rows], far[rows] = keys(matrix(own, 0, len(rows), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size.astype(np.int32)), pa.array(part), pa.array(far)], ["vec_id", "vec", "dim", "part", "far"])

    return df.mapInArrow(run, "vec_id long, vec array<double>, dim int, part int, far double")


def pack(spark: SparkSession, indexed: DataFrame, rows: int, n: int) -> DataFrame:
    """Blocks of at most `rows` vectors of one length and part, in order of (dim, part, far, id): ids, vectors, what they
    are sorted by (far, from low to high), their number n and the largest squared norm. `block` numbers them, `place`
    counts those of one range, length and part. Written, so that the numbers don't change.

    Vectors that are all alike are told apart by their ids, repeated rows by a drawn number, so no range holds them all.
    """
    ranges = max(1, min(RANGES, -(-n // (4 * rows))))
    dealt = checkpoint(spark, indexed.withColumn("deal", F.rand(7))).repartitionByRange(ranges, "dim", "part", "far", "vec_id", "deal").sortWithinPartitions("dim", "part", "far", "vec_id").drop("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made, place, key = 0, 0, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        far: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            x, f = np.concatenate(vectors), np.concatenate(far).astype("<f8")
            kind, data = dump(x)
            with np.errstate(over="ignore"):
                most = float((x * x).sum(1).max())
            row = {"block": first + made, "place": place, "dim": key[0], "part": key[1], "n": len(x), "most": most, "ids": np.concatenate(ids).astype("<i8").tobytes()}
            row |= {"kind": kind, "data": data, "far": f.tobytes(), "low": float(f[0]), "high": float(f[-1])}
            return pa.RecordBatch.from_pylist([row], PACKED_SCHEMA)

        for batch in batches:
            dim, part = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(dim) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(dim)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                while lo < hi:
                    now = (int(dim[lo]), int(part[lo]))
                    if key is not None and (now != key or held == rows):
                        yield out()
                        made, place = made + 1, place + 1 if now == key else 0
                        ids, vectors, far, held = [], [], [], 0
                    key = now
                    to = min(hi, lo + rows - held)
                    ids.append(batch.column(0).to_numpy()[lo:to])
                    vectors.append(matrix(batch.column(1), lo, to, now[0]))
                    far.append(batch.column(4).to_numpy()[lo:to])
                    held, lo = held + to - lo, to
        if held:
            yield out()

    return checkpoint(spark, dealt.mapInArrow(run, PACKED))


def grid(pairs: DataFrame, data: DataFrame, asked: DataFrame) -> DataFrame:
    """The blocks of each wanted pair side by side. pairs: (unit, q, first, blocks): query block q with all blocks of
    a unit, which are those with place first to first + blocks - 1; data has `unit`, asked has `q`."""
    ask = pairs.withColumn("gb", F.explode(F.sequence(F.floor(F.col("first") / SIDE), F.floor((F.col("first") + F.col("blocks") - 1) / SIDE))))
    ask = ask.withColumn("gq", F.floor(F.col("q") / SIDE))
    # which groups of query blocks a group of data blocks has to meet: small rows, the blocks themselves come after
    met = ask.select("unit", "gb", "gq").distinct()
    left = data.withColumn("gb", F.floor(F.col("place") / SIDE)).join(met, ["unit", "gb"])
    return left.join(ask.join(asked, "q"), ["unit", "gb", "gq"]).where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("blocks")))


def asked_columns(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data"))


def numbered(spark: SparkSession, packed: DataFrame) -> DataFrame:
    """Query blocks with numbers from 0 on without gaps, so that SIDE of them are a group; one small row is ranked for
    each range, not for each block."""
    ranges = packed.groupBy(F.shiftright("block", 32).alias("range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    offsets = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = packed.withColumn("range", F.shiftright("block", 32)).join(F.broadcast(offsets), "range")
    return checkpoint(spark, at.withColumn("block", F.col("before") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))).select(*packed.columns))


def best_of_blocks(blocks: DataFrame, k: int, score_type: str, kernel: Callable) -> DataFrame:
    """query_id, vec_id, score: the best of each pair of blocks. kernel(query ids, queries, more, part, ids, vectors, far,
    k) gives (query number, id, score); `more` is what the query block carries beside, or empty."""
    kind = pa.int64() if score_type == "long" else pa.float64()
    if "more" not in blocks.columns:
        blocks = blocks.withColumn("more", F.lit(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                q_ids = np.frombuffer(r["q_ids"], "<i8")
                got = kernel(q_ids, load(r["q_kind"], r["q_data"], r["dim"]), np.frombuffer(r["more"], "<f8"), r["part"], np.frombuffer(r["ids"], "<i8"), load(r["kind"], r["data"], r["dim"]), np.frombuffer(r["far"], "<f8"), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[got[0]], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], kind)], ["query_id", "vec_id", "score"])

    wanted = blocks.select("dim", "part", "ids", "kind", "data", "far", "q_ids", "q_kind", "q_data", "more")
    return wanted.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")


def ranked(found: DataFrame, k: int, order: Callable[[Column], Column]) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller id."""
    by = Window.partitionBy("query_id").orderBy(order(F.col("score")), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def small_vector_batches(spark: SparkSession) -> None:
    small_batches(spark, 1024)
