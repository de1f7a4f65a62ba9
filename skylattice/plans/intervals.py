"""Interval algebra, runs and chains: window expressions partitioned by the caller's keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.plans.ranking import earlier_parts


def interval_union(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Length of the union of intervals per key, their number and the number of islands; touching intervals merge."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    new = F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("__reach"), F.col(start)))
    return (
        df.withColumn("__reach", reach)
        .withColumn("__new", F.greatest(new, F.lit(0)))
        .withColumn("__island", (F.col("__reach").isNull() | (F.col(start) > F.col("__reach"))).cast("long"))
        .groupBy(*keys)
        .agg(F.count("*").alias("intervals"), F.sum("__new").alias("union_length"), F.sum("__island").alias("islands"))
    )


def merged_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """One row for each island of overlapping or touching intervals."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__first", (reach.isNull() | (F.col(start) > reach)).cast("long"))
    return marked.withColumn("island", F.sum("__first").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))


def bucketed_union(df: DataFrame, keys: Sequence[str], start: str, end: str, bucket: int) -> DataFrame:
    """interval_union where one key holds very many intervals: islands are merged within buckets of the start first, so
    no task holds a key's intervals, only its islands."""
    cut = df.withColumn("__bucket", F.floor(F.col(start) / bucket))
    islands = merged_intervals(cut, [*keys, "__bucket"], start, end)
    out = interval_union(islands, keys, start, end)
    counts = islands.groupBy(*keys).agg(F.sum("members").alias("__n"))
    return out.join(counts, list(keys)).withColumn("intervals", F.col("__n")).drop("__n")


def contiguous_runs(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Runs of intervals that meet exactly; `overlap` counts those that start before the last one ended (an error)."""
    by = Window.partitionBy(*keys).orderBy(start)
    marked = df.withColumn("__last", F.lag(end).over(by)).withColumn("__new", (F.col("__last").isNull() | (F.col(start) != F.col("__last"))).cast("long"))
    runs = marked.withColumn("run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"), F.sum((F.col(start) < F.col("__last")).cast("long")).alias("overlap"))


def threshold_runs(df: DataFrame, keys: Sequence[str], position: str, value: str, threshold: float, least: int = 1) -> DataFrame:
    """Runs of neighbouring positions at or above the threshold: first, last, length, peak (first of the largest)."""
    above = df.where(F.col(value) >= threshold)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    runs = above.withColumn("__run", F.col(position) - nth)
    best = F.max_by(position, F.struct(F.col(value), -F.col(position)))
    return runs.groupBy(*keys, "__run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length"), best.alias("peak"), F.max(value).alias("peak_value")).where(F.col("length") >= least).drop("__run")


def chain_clusters(df: DataFrame, keys: Sequence[str], time: str, score: str, gap: Column | float, tie: str, part: float | None = None) -> DataFrame:
    """Single linkage in time: a row joins the cluster of the row before it if it is at most `gap` later. The rows keep
    their columns; `cluster` numbers clusters, `best` marks the first of the highest scores.

    With `part` a key is cut into parts of that length of time, which are chained on their own and learn from the parts
    before when those end and how many clusters they begin; that is for keys with very many rows.
    """
    own = list(keys) if part is None else [*keys, "__part"]
    by = Window.partitionBy(*own).orderBy(time, tie)
    before = F.lag(time).over(by)
    rows = df
    if part is not None:
        rows = earlier_parts(df.withColumn("__part", F.floor(F.col(time) / part)), keys, "__part", "__ended", F.max(time), lambda c: F.max(c))
        before = F.coalesce(before, F.col("__ended"))
    marked = rows.withColumn("__new", F.coalesce((F.col(time) - before > gap).cast("long"), F.lit(1)))
    number = F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    if part is None:
        numbered = marked.withColumn("cluster", number).drop("__new")
    else:
        marked = earlier_parts(marked, keys, "__part", "__begun", F.sum("__new"), lambda c: F.sum(c))
        numbered = marked.withColumn("cluster", number + F.coalesce("__begun", F.lit(0))).drop("__new", "__part", "__ended", "__begun")
    nth = F.row_number().over(Window.partitionBy(*keys, "cluster").orderBy(F.desc(score), time, tie))
    return numbered.withColumn("best", nth == 1)


def aligned_windows(df: DataFrame, start: str, end: str, duration: int, stride: int, block: int | None = None) -> DataFrame:
    """Windows [w, w + duration) with w a multiple of the stride, inside each row's [start, end); with a block size,
    windows that cross a boundary of the row's blocks, which begin at its start, are left out."""
    first, last = F.ceil(F.col(start) / stride) * stride, F.col(end) - duration
    grid = df.where(first <= last).withColumn("window_start", F.explode(F.sequence(first.cast("bigint"), F.floor(last).cast("bigint"), F.lit(stride).cast("bigint"))))
    grid = grid.withColumn("window_end", F.col("window_start") + duration)
    at = lambda c: F.floor((c - F.col(start)) / block)
    return grid if block is None else grid.where(at(F.col("window_start")) == at(F.col("window_end") - 1))
