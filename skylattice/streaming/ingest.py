"""Structured Streaming: windows, sessions, vetoes and exactly-once ingest of shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, time: str, duration: str, slide: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of `value` in tumbling or sliding windows; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, duration, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, late: str, key: str, *keys: str) -> DataFrame:
    """Chains of events of one key at most a gap apart (equality joins), with their highest value."""
    keys = (key, *keys)
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("n"), F.max("value").alias("best")).select(F.col("s.start").alias("first"), F.col("s.end").alias("end"), *keys, "n", "best")


def without_vetoes(stream: DataFrame, time: str, vetoes: DataFrame) -> DataFrame:
    """Stream rows outside all vetoes [start, end), a static table of bounded size: a stream-static anti join on days."""
    v = vetoes.withColumn("__day", F.explode(F.sequence(F.to_date("start"), F.to_date("end")))).select("__day", F.col("start").alias("__s"), F.col("end").alias("__e"))
    rows = stream.withColumn("__day", F.to_date(time))
    return rows.join(v, (rows["__day"] == v["__day"]) & (F.col(time) >= v["__s"]) & (F.col(time) < v["__e"]), "left_anti").drop("__day")


def coincidences(first: DataFrame, second: DataFrame, time: str, score: str, row: str, band_seconds: float, gap: str, late: str, *keys: str) -> DataFrame:
    """keys, start, end, pairs, best_score, best: clusters of pairs of two detectors' candidates, streams or tables.

    Candidates of equal keys (a slide, whose offset the second time already has) pair if their times are within the band.
    Both streams have watermarks and the join has bounds on time, so the state holds what can still be paired. Pairs are
    chained by the first one's time, at most a gap apart; a cluster comes out when the watermark has passed it, with the
    best pair (the lower score of the two counts; the larger ids among equals).
    """
    band = int(round(band_seconds * 1_000_000))
    at = lambda df, n: df.withWatermark(time, late).select(*[F.col(k).alias(f"{n}_{k}") for k in keys], F.col(time).alias(f"{n}_time"), F.col(score).alias(f"{n}_score"), F.col(row).cast("string").alias(f"{n}_id"), F.floor(F.unix_micros(time) / max(1, band)).alias(f"{n}_stretch"))
    a, b = at(first, "a"), at(second, "b")
    b = b.withColumn("b_stretch", F.explode(F.array(*[F.col("b_stretch") + d for d in (-1, 0, 1)])))
    width = F.expr(f"INTERVAL {band} MICROSECONDS")
    near = (F.col("a_stretch") == F.col("b_stretch")) & (F.col("a_time") >= F.col("b_time") - width) & (F.col("a_time") <= F.col("b_time") + width)
    for k in keys:
        near &= F.col(f"a_{k}") == F.col(f"b_{k}")
    pairs = a.join(b, near).withColumn("score", F.least("a_score", "b_score"))
    best = F.max(F.struct("score", "a_id", "b_id")).alias("best")
    out = pairs.groupBy(F.session_window("a_time", gap).alias("w"), *[F.col(f"a_{k}").alias(k) for k in keys]).agg(F.count("*").alias("pairs"), F.max("a_time").alias("end"), best)
    return out.select(*keys, F.col("w.start").alias("start"), "end", "pairs", F.col("best.score").alias("best_score"), F.concat_ws(":", "best.a_id", "best.b_id").alias("best"))


def ingest_shards(stream: DataFrame, path: str, checkpoint: str, key: str, split: Column, late: str, time: str, process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append new rows once, in folders of their split, in as many batches as there are waiting, then stop.

    A key that comes again within the watermark is left out; older keys are forgotten, so the state is bounded. The
    split depends on the row alone, so late shards never change earlier ones. The batch number names the folder that
    a batch writes, so a batch that is repeated after a failure replaces its own output.
    """
    rows = stream.withColumn("split", split)
    rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        out = process(batch) if process else batch
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "split").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
