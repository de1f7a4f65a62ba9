"""Background windows: an aligned grid, and the first reason why a window can't be used."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.contracts import ContractError

#: Reasons in the order in which they are looked for, fixed values.
REASONS = (
    "insufficient_preprocessing_context",
    "crosses_gps_block_boundary",
    "catalog_or_declared_exclusion",
    "incomplete_quality_context",
    "required_dq_bits_missing_in_context",
    "required_no_injection_bits_missing_in_context",
)


def plan_windows(
    spark: SparkSession,
    coverage: DataFrame,
    quality: DataFrame,
    exclusions: DataFrame | None = None,
    duration: int = 8,
    stride: int = 8,
    block: int = 256,
    context: int | None = None,
    dq_bits: int = 1,
    injection_bits: int = 0,
) -> DataFrame:
    """All windows of the grid: gps_start, gps_end, ifos, gps_block, window_id, dq_and, inj_and, reason (null: usable).

    coverage (ifo, gps_start, gps_end) has a row for each detector, quality (ifo, gps, dq, inj) one for each second,
    exclusions (start, end) half-open intervals. The grid holds the multiples of the stride in the interval that all
    detectors cover; blocks start with that interval. A window needs its context (about its middle) inside of it, lies
    in one block, overlaps no exclusion, and has every second of its context of every detector with all required bits.
    The first reason counts: in the order of REASONS, and of the quality ones that of the first detector by name.

    Each second is sent to the few windows whose context holds it and combined there; no window looks seconds up.
    """
    context = context or duration
    if min(duration, stride, block) <= 0 or duration > block or context < duration:
        raise ValueError("a window must fit into its block and its context")
    r = coverage.agg(F.max("gps_start").alias("a"), F.min("gps_end").alias("b"), F.sort_array(F.collect_set("ifo")).alias("ifos")).first()
    if not r["ifos"] or r["b"] - r["a"] < duration:
        raise ContractError("the detectors have no common interval that holds a window")
    start, end, ifos = r["a"], r["b"], r["ifos"]
    first = math.ceil(start / stride) * stride
    grid = spark.range(first, max(first, end - duration + 1), stride).select(F.col("id").alias("gps_start"), (F.col("id") + duration).alias("gps_end"))
    middle = (F.col("gps_start") + F.col("gps_end")) / 2
    low, high = F.floor(middle - context / 2), F.ceil(middle + context / 2)
    begins = F.lit(start) + F.floor((F.col("gps_start") - start) / block) * block
    grid = grid.withColumns({"low": low, "high": high, "block_start": begins, "outside": (middle - context / 2 < start) | (middle + context / 2 > end)})

    # a second x is in the context of the windows that start in (x - duration / 2 - context / 2 - 1, x - duration / 2 + context / 2 + 1)
    reach = duration / 2 + context / 2 + 1
    lowest = F.ceil((F.col("gps") - reach) / stride) * stride
    highest = F.floor((F.col("gps") - duration / 2 + context / 2 + 1) / stride) * stride
    near = quality.where(F.col("ifo").isin(ifos) & (lowest <= highest)).withColumn("gps_start", F.explode(F.sequence(lowest, highest, F.lit(stride).cast("bigint"))))
    held = F.col("gps_start") + duration / 2
    near = near.where((F.col("gps") >= F.floor(held - context / 2)) & (F.col("gps") < F.ceil(held + context / 2)))
    lacks = lambda c, bits: F.coalesce(F.bool_or(F.col(c).bitwiseAND(F.lit(bits)) != bits), F.lit(False)) if bits else F.lit(False)
    seen = near.groupBy("gps_start", "ifo").agg(F.count("*").alias("seconds"), F.bit_and("dq").alias("dq"), F.bit_and("inj").alias("inj"), lacks("dq", dq_bits).alias("bad_dq"), lacks("inj", injection_bits).alias("bad_inj"))
    wanted = grid.select("gps_start", "low", "high", F.explode(F.array(*[F.lit(i) for i in ifos])).alias("ifo")).join(seen, ["gps_start", "ifo"], "left")
    reason = F.when(F.coalesce("seconds", F.lit(0)) != F.col("high") - F.col("low"), REASONS[3]).when(F.col("bad_dq"), REASONS[4]).when(F.col("bad_inj"), REASONS[5])
    by = wanted.withColumn("r", reason).groupBy("gps_start").agg(F.min(F.when(F.col("r").isNotNull(), F.struct("ifo", "r"))).alias("bad"), F.bit_and("dq").alias("dq_and"), F.bit_and("inj").alias("inj_and"))

    if exclusions is None:
        excluded = grid.select("gps_start").limit(0)
    else:
        e = exclusions.where("start < end").select(F.col("start").alias("__s"), F.col("end").alias("__e"))
        e = e.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / block).cast("bigint"), F.floor(F.col("__e") / block).cast("bigint"))))
        g = grid.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor(F.col("gps_start") / block), F.floor(F.col("gps_end") / block)))))
        excluded = g.join(e, (g["__b"] == e["__b"]) & (g["gps_start"] < e["__e"]) & (g["gps_end"] > e["__s"]), "left_semi").select("gps_start").distinct()
    out = grid.join(by, "gps_start").join(excluded.withColumn("excluded", F.lit(True)), "gps_start", "left")
    why = F.when(F.col("outside"), REASONS[0]).when(F.col("gps_end") > F.col("block_start") + block, REASONS[1]).when(F.col("excluded"), REASONS[2]).otherwise(F.col("bad.r"))
    names = F.array(*[F.lit(i) for i in ifos])
    identity = F.substring(F.sha2(F.to_json(F.struct(F.col("gps_start").alias("gps"), names.alias("ifos"))), 256), 1, 20)
    return out.select(
        "gps_start", "gps_end", names.alias("ifos"), F.concat(F.lit("gps:"), F.col("block_start").cast("string"), F.lit(f":{block}")).alias("gps_block"),
        F.concat(F.lit("background-"), identity).alias("window_id"), "dq_and", "inj_and", why.alias("reason"),
    )


def rejection_counts(windows: DataFrame) -> DataFrame:
    """reason, windows: how many windows each reason rejects; usable ones count as `usable`."""
    return windows.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("windows"))
