"""Exact bootstrap resamples of keys of any size: the number of draws is split down a tree of cells.

A resample of n rows is n draws with replacement. Rows lie in cells by the bits of their hash; how many of the draws fall
into a cell is multinomial given the cells' sizes, and what falls into a cell's parts is multinomial again, down to
cells small enough for one task, where rows are drawn. Every generator is seeded by its key and cell alone, so the
resamples are the same for any order and partitioning, and each has n draws exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.graph import checkpoint

#: Rows of a cell that is drawn from, and bits of the hash that one level of the tree goes by.
CELL, BITS = 2048, 6


def _generator(*parts: int) -> np.random.Generator:
    return np.random.default_rng([p & 0xFFFFFFFFFFFFFFFF for p in parts])


def replicate_sums(df: DataFrame, keys: Sequence[str], row: str, values: dict[str, Column], replicates: int = 500, seed: int = 0) -> DataFrame:
    """keys, replicate (from 0), draws, and the sum of each of `values` over the drawn rows.

    `row` identifies a row within its key; null values count as 0. Null keys are keys.
    """
    spark = df.sparkSession
    names, sums = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(values))]
    kinds = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))
    head = f"{kinds}, " if kinds else ""
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.xxhash64(*[F.col(k) for k in keys], F.lit("key")).alias("of"), F.xxhash64(F.lit(71), row).alias("h"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for c, n in zip(values.values(), sums, strict=True)])
    largest = rows.groupBy(*names, "of").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, largest / CELL)) / BITS))
    cell = F.shiftrightunsigned("h", 64 - BITS * levels) if levels else F.lit(0).cast("bigint")
    rows = rows.withColumn("cell", cell)
    counts = checkpoint(spark, rows.groupBy(*names, "of", "cell").agg(F.count("*").alias("n")))

    def split(level: int):
        def run(key: tuple, parent: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            """The draws of a cell over its parts."""
            parts = parts.sort_values("part")
            draws = np.asarray(parent["draws"].iloc[0], np.int64)
            size = parts["size"].to_numpy()
            into = _generator(seed, int(key[0]), int(key[1]), level).multinomial(draws, size / size.sum())
            head = {n: [parent[n].iloc[0]] * len(parts) for n in names}
            return pd.DataFrame(head | {"of": [key[0]] * len(parts), "cell": parts["part"].tolist(), "n": size, "draws": list(into.T)})

        return run

    top = counts.groupBy(*names, "of").agg(F.sum("n").alias("n")).select(*names, "of", F.lit(0).cast("bigint").alias("cell"), "n", F.array_repeat("n", replicates).alias("draws"))
    for level in range(levels):
        down = BITS * (levels - level - 1)
        parts = counts.groupBy(F.col("of").alias("key"), F.shiftrightunsigned("cell", down).alias("part")).agg(F.sum("n").alias("size")).withColumn("above", F.shiftrightunsigned("part", BITS))
        top = top.groupBy("of", "cell").cogroup(parts.groupBy("key", "above")).applyInPandas(split(level), f"{head}of long, cell long, n long, draws array<long>")

    def draw(key: tuple, cells: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """Sums of the rows that are drawn in a cell."""
        own = own.sort_values(["h", *sums], kind="stable")
        x = own[sums].to_numpy(float)
        draws = np.asarray(cells["draws"].iloc[0], np.int64)
        rng = _generator(seed, int(key[0]), int(key[1]), -1)
        out = np.zeros((len(draws), len(sums)))
        for r, k in enumerate(draws.tolist()):
            out[r] = np.bincount(rng.integers(0, len(x), k), minlength=len(x)) @ x
        first = {n: [own[n].iloc[0]] for n in names}
        return pd.DataFrame(first | {"draws": [draws]} | {n: [out[:, i]] for i, n in enumerate(sums)})

    schema = head + "draws array<long>, " + ", ".join(f"{n} array<double>" for n in sums)
    parts = top.groupBy("of", "cell").cogroup(rows.groupBy("of", "cell")).applyInPandas(draw, schema)
    each = parts.select(*names, F.posexplode(F.arrays_zip("draws", *sums)).alias("replicate", "x"))
    out = each.groupBy(*names, "replicate").agg(F.sum("x.draws").alias("draws"), *[F.sum(f"x.{n}").alias(n) for n in sums])
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "replicate", "draws", *[F.col(n).alias(k) for n, k in zip(sums, values, strict=True)])


def resampled(df: DataFrame, keys: Sequence[str], row: str, numerator: Column, denominator: Column | None = None, replicates: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """keys, low, high: percentile interval of sum(numerator) / sum(denominator), or of the sum alone, over resamples of
    a key's rows. Resamples whose denominator is 0 don't count."""
    sums = replicate_sums(df, keys, row, {"__a": numerator} if denominator is None else {"__a": numerator, "__b": denominator}, replicates, seed)
    value = F.col("__a") if denominator is None else F.when(F.col("__b") > 0, F.col("__a") / F.col("__b"))
    tail = (1 - level) / 2
    out = sums.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))  # of the replicates
    return out.select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
