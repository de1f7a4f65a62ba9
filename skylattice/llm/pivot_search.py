"""Exact top-k inner products with a pivot-distance index.

A vector is keyed by its nearest pivot and its distance to it, and all vectors are sorted by that key. A sorted range of
one pivot is an annulus [a, b]: for a query q the triangle inequality gives d(q, x) >= max(0, d(q, p) - b, a - d(q, p)),
and with the largest norm r of the annulus q.x <= (|q|^2 + r^2 - d^2) / 2.

Queries are sorted and packed by the same key. A first pass looks into one block of the annulus with the best bounds for
each block of queries and so learns a score that the k-th best reaches at least. A second pass joins a block of queries
with those annuli only whose bound reaches that score for one of its queries. In a pair of blocks, small annuli are
expanded from the best bound on, and the search of a query stops when no bound reaches its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import checkpoint
from skylattice.llm.vector_blocks import QUERIES, ROWS, best_of_blocks, grid, load, numbered, pack, queries_of, ranked, small_vector_batches, valid_vectors, with_index

#: The sample that pivots are chosen from, pivots, rows of a small annulus, annuli of the first pass for each block of
#: queries, and the largest number that is exact as a double.
SAMPLE, PIVOTS, ANNULUS, PROBES, EXACT = 2048, 32, 64, 4, 2.0**53


def choose_pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal."""
    if not len(x):
        return x
    at, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(at) < min(n, len(x)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[at[-1]], axis=1))
    return x[at]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T))


def bounds(q: np.ndarray, near: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with a vector of each annulus. near: distance of the query to the pivot
    of each annulus, low and high: the annulus, most: largest squared norm in it. Rounding only makes it larger."""
    norm = (q * q).sum(1)
    # a squared distance from sums of squares is off by some 1e-15 of those, its root by the root of that
    off = 1e-7 * (1 + near + high + np.sqrt(norm)[:, None] + np.sqrt(most))
    gap = np.maximum(0, np.maximum(near - high, low - near) - off)
    bound = (norm[:, None] + most - gap * gap) / 2
    bound = bound + 1e-9 * (norm[:, None] + most) + 1e-3
    return np.where(np.isfinite(bound), bound, np.inf)  # numbers so large that squares overflow aren't bounded


def annuli(n: int) -> list[tuple[int, int]]:
    """Ranges of at most ANNULUS of n rows that are sorted by distance."""
    return [(a, min(a + ANNULUS, n)) for a in range(0, n, ANNULUS)]


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; in Python's integers where doubles could round."""
    if exact:
        return q @ x.T
    return np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q], dtype=object)


def search_block(p: np.ndarray, q_ids: np.ndarray, q: np.ndarray, reach: np.ndarray, ids: np.ndarray, x: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, list[int], list[int]]:
    """The k best of a block for each query, its own row left out. p is the pivot of the block; reach (or nothing) is a
    score that each query is known to reach k times, dist the sorted distances of the vectors."""
    ranges = annuli(len(ids))
    norm, q_norm = (x * x).sum(1), (q * q).sum(1)
    near = np.repeat(distances(q, p[None, :]), len(ranges), axis=1)
    low, high = np.array([dist[a] for a, _ in ranges]), np.array([dist[b - 1] for _, b in ranges])
    bound = bounds(q, near, low, high, np.array([norm[a:b].max() for a, b in ranges]))
    exact = float(np.sqrt(norm.max() * q_norm.max())) * 1.01 < EXACT
    none = -np.inf if exact else -(1 << 2200)
    top = np.full((len(q), k), none, dtype=np.float64 if exact else object)
    top_id = np.full((len(q), k), np.iinfo(np.int64).max)
    order = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(len(q))
    floor = reach if len(reach) else np.full(len(q), -np.inf)
    for step in range(len(ranges)):
        at = order[live, step]
        kth = np.array([-np.inf if v == none else float(v) for v in top[live, k - 1]]) if not exact else top[live, k - 1]
        go = bound[live, at] * (1 + 1e-12) >= np.maximum(kth, floor[live])
        live, at = live[go], at[go]
        if not len(live):
            break
        for r in np.unique(at).tolist():
            rows, (a, b) = live[at == r], ranges[r]
            s = products(q[rows], x[a:b], exact)
            s[q_ids[rows][:, None] == ids[None, a:b]] = none
            all_s = np.concatenate([top[rows], s], axis=1)
            all_id = np.concatenate([top_id[rows], np.broadcast_to(ids[a:b], s.shape)], axis=1)
            best = np.lexsort((all_id, -all_s), axis=-1)[:, :k] if exact else np.array([sorted(range(all_s.shape[1]), key=lambda j, i=i: (-all_s[i, j], all_id[i, j]))[:k] for i in range(len(rows))])
            top[rows], top_id[rows] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_id, best, 1)
    at, j = np.nonzero(top > none)
    scores = [int(v) for v in top[at, j]]
    if any(abs(v) >= 1 << 63 for v in scores):
        raise OverflowError("an inner product doesn't fit into a long")
    return at, top_id[at, j].tolist(), scores


def exact_top_k(spark: SparkSession, df: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k other rows with the highest
    inner product of floor(scale * x), ties to the smaller id.

    Vectors that are null, empty or hold null or non-finite components take no part; vectors meet only those of their
    own length. With fewer than k candidates all are returned; an empty table gives an empty result; other columns
    aren't read. Of rows repeated with one id the smallest vector asks, and each is a candidate of other ids' rows. An
    inner product of a result that doesn't fit into a long is an error.
    """
    small_vector_batches(spark)
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    base = valid_vectors(df, id_col, vec_col).withColumn("vec", F.transform("vec", lambda x: whole(x * scale)))
    sample: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).collect():  # a bounded sample
        sample.setdefault(len(r["vec"]), []).append(r["vec"])
    pivots = {d: choose_pivots(np.array(v)) for d, v in sample.items()}
    shared = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors of each length

    def pivots_of(dim: int) -> np.ndarray:
        return shared.value.get(dim, np.zeros((1, dim)))

    def key(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(x, pivots_of(x.shape[1]))
        part = d.argmin(1)
        return part.astype(np.int32), d[np.arange(len(x)), part]

    n = base.count()
    data = pack(spark, with_index(base, key), ROWS, n)
    queries = queries_of(base, every)
    asked = numbered(spark, pack(spark, with_index(queries, key), QUERIES, queries.count()))

    # an annulus of the whole table: the blocks of one range, length and pivot
    unit = F.struct(F.shiftright("block", 32).alias("range"), "dim", "part")
    found = data.groupBy(unit.alias("unit")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most"), F.sum("n").alias("n"), F.count("*").alias("blocks"))
    units: dict[int, list] = {}
    for r in found.orderBy("unit").collect():  # RANGES rows at most, and PIVOTS for each length
        units.setdefault(r["unit"]["dim"], []).append((r["unit"]["range"], r["unit"]["part"], r["low"], r["high"], r["most"], r["n"], r["blocks"]))
    table = spark.sparkContext.broadcast({d: (np.array([u[:2] for u in v], np.int64), np.array([u[2:5] for u in v]), np.array([u[5:] for u in v], np.int64)) for d, v in units.items()})

    def bounds_of(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, numbers, counts = table.value[q.shape[1]]
        p = pivots_of(q.shape[1])
        return names, counts, bounds(q, distances(q, p)[:, names[:, 1]], *numbers.T)

    wanted = pa.schema([("range", pa.int64()), ("dim", pa.int32()), ("part", pa.int32()), ("q", pa.int64()), ("first", pa.int64()), ("blocks", pa.int64())])

    def choose(first_pass: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                    if r["dim"] not in table.value:
                        continue
                    q = load(r["q_kind"], r["q_data"], r["dim"])
                    names, counts, bound = bounds_of(q)
                    if first_pass:  # the annuli that are best for most queries; any choice gives a true score
                        votes = np.bincount(np.where(counts[:, 0] > k, bound, -np.inf).argmax(1), minlength=len(names))
                        at = [u for u in np.argsort(-votes, kind="stable")[:PROBES].tolist() if votes[u]]
                    else:
                        at = np.flatnonzero((bound * (1 + 1e-12) >= np.frombuffer(r["more"], "<f8")[:, None]).any(0)).tolist()
                    rows = [{"range": int(names[u, 0]), "dim": r["dim"], "part": int(names[u, 1]), "q": r["q"], "first": r["q"] % int(counts[u, 1]) if first_pass else 0, "blocks": 1 if first_pass else int(counts[u, 1])} for u in at]
                    yield pa.RecordBatch.from_pylist(rows, wanted)

        return run

    def kernel(q_ids, q, reach, part, ids, x, far, k):
        return search_block(pivots_of(q.shape[1])[part], q_ids, q, reach, ids, x, far, k)

    def pairs_of(blocks: DataFrame, first_pass: bool) -> DataFrame:
        chosen = blocks.mapInArrow(choose(first_pass), "range long, dim int, part int, q long, first long, blocks long")
        return checkpoint(spark, chosen.select(F.struct("range", "dim", "part").alias("unit"), "q", "first", "blocks"))

    data = data.withColumn("unit", unit)
    blocks = asked.select("dim", F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data"))
    probed = best_of_blocks(grid(pairs_of(blocks, True), data, blocks.drop("dim")), k, "long", kernel)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = probed.withColumn("nth", F.row_number().over(by)).where(F.col("nth") == k).select("query_id", F.col("score").cast("double").alias("reach"))
    kth = checkpoint(spark, kth)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), q)), pa.array(np.arange(len(own)))], ["query_id", "q", "i"])

    places = blocks.select("q", "q_ids").mapInArrow(unpack, "query_id long, q long, i long").join(kth, "query_id", "left")
    # a score of few digits less than what was found, where a long doesn't fit into a double
    safe = F.coalesce(F.col("reach") - F.abs("reach") * 1e-12, F.lit(float("-inf")))
    reach = places.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", safe.alias("s")))), lambda x: x["s"]).alias("reach"))  # QUERIES numbers

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, "<f8").tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["q", "more"])

    armed = checkpoint(spark, blocks.join(reach.mapInArrow(as_bytes, "q long, more binary"), "q"))
    return ranked(best_of_blocks(grid(pairs_of(armed, False), data, armed.drop("dim")), k, "long", kernel), k, F.desc)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""
