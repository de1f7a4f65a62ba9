"""Packing in order, without a loop over all components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.contracts import failing, require
from skylattice.operators.graph import checkpoint
from skylattice.plans.ranking import ranked

#: Ranges whose maps are joined in one task.
JOINED = 32


def _packed(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """(2, capacity + 1): how many shards further items of these sizes lead, and how full the last one is then, for each
    fill that the first one has before them."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    # from an item that opens a shard: the next item that opens one, found from the back
    further, full = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    opens = np.searchsorted(total, total[:-1] + capacity, "right") - 1  # the first item that doesn't fit behind
    opens = np.maximum(opens, np.arange(n) + 1)
    for i in range(n - 1, -1, -1):
        j = int(opens[i])
        further[i], full[i] = (0, total[n] - total[i]) if j >= n else (further[j] + 1, full[j])
    fill = np.arange(capacity + 1)
    first = np.searchsorted(total, capacity - fill, "right") - 1  # the first item that the shard doesn't hold any more
    stays = first >= n
    return np.stack([np.where(stays, 0, further[np.minimum(first, n - 1)] + 1 if n else 0), np.where(stays, fill + total[n], full[np.minimum(first, n - 1)] if n else fill)])


def next_fit(spark: SparkSession, components: DataFrame, order: Sequence, size: str, capacity: int, each: int = 1 << 16) -> DataFrame:
    """components with `shard`: in order, each goes to the current shard or, if it doesn't fit, opens the next one. A component
    larger than the capacity has a shard of its own.

    Components are cut into ranges. A range is a map from how full the shard before it is to how many shards further it
    leads and how full the last one is then: capacity + 1 pairs of numbers. Sizes are whole numbers from 1. Maps of ranges are joined up a tree, and
    what each range begins with comes down it; only then are components numbered, range by range. So no loop and no task
    has all components, and the result is that of the loop.
    """
    require(failing(components, size=F.col(size) >= 1).select(size, "failed"), "a component has no size")
    sizes = F.least(F.col(size).cast("bigint"), F.lit(capacity))
    rows = ranked(spark, components, order, "__pos").withColumns({"__range": F.floor(F.col("__pos") / each), "__size": sizes})
    rows = checkpoint(spark, rows)
    schema = "range long, further array<long>, full array<long>"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        m = _packed(pdf["size"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"range": [int(pdf["range"].iloc[0])], "further": [m[0]], "full": [m[1]]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        further, full = np.zeros(capacity + 1, np.int64), np.arange(capacity + 1)
        for r in pdf.sort_values("range").itertuples():
            further, full = further + np.asarray(r.further)[full], np.asarray(r.full)[full]
        return pd.DataFrame({"range": [int(pdf["above"].iloc[0])], "further": [further], "full": [full]})

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, fill, out = int(pdf["shard"].iloc[0]), int(pdf["fill"].iloc[0]), []
        for r in pdf.sort_values("range").itertuples():
            out.append((r.range, shard, fill))
            shard, fill = shard + int(r.further[fill]), int(r.full[fill])
        return pd.DataFrame(out, columns=["range", "shard", "fill"])

    levels = [checkpoint(spark, rows.select(F.col("__range").alias("range"), F.col("__pos").alias("at"), F.col("__size").alias("size")).groupBy("range").applyInPandas(one, schema))]
    last = (levels[0].agg(F.max("range")).first()[0] or 0) // JOINED
    while last > 0:
        levels.append(checkpoint(spark, levels[-1].withColumn("above", F.floor(F.col("range") / JOINED)).groupBy("above").applyInPandas(joined, schema)))
        last //= JOINED
    start = spark.range(1).select(F.col("id").alias("above"), F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("fill"))
    for maps in reversed(levels):
        below = maps.withColumn("above", F.floor(F.col("range") / JOINED)).join(start, "above")
        start = below.groupBy("above").applyInPandas(begin, "range long, shard long, fill long").withColumnRenamed("range", "above")
    placed = rows.join(start.withColumnRenamed("above", "__range"), "__range")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        shard, fill, out = int(pdf["shard"].iloc[0]), int(pdf["fill"].iloc[0]), []
        for n in pdf["__size"].tolist():
            if fill and fill + n > capacity:
                shard, fill = shard + 1, 0
            fill += n
            out.append(shard)
        return pdf[["__pos"]].assign(shard=out)

    numbers = placed.select("__range", "__pos", "__size", "shard", "fill").groupBy("__range").applyInPandas(number, "__pos long, shard long")
    return rows.join(numbers, "__pos").drop("__pos", "__range", "__size")
