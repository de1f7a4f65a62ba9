"""Timing calibration of candidates, annotation panels, rule grids, overrides, and per-row scoring hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.contracts import ContractError, broken_dependency, duplicates, failing, finite, missing_references, require, uncontrolled
from skylattice.functions.columns import all_gates, wilson


def timing_matches(candidates: DataFrame, arrivals: DataFrame, association: float) -> DataFrame:
    """The best candidate of each method for each arrival (injection_id, ifo, arrival) within the association: absolute
    error and resolution; among equals the smallest candidate_id. Combines before its shuffle."""
    near = candidates.join(arrivals, ["injection_id", "ifo"]).withColumn("error", F.abs(F.col("gps_peak") - F.col("arrival"))).where(F.col("error") <= association)
    best = near.groupBy("timing_method", "injection_id", "ifo").agg(F.min(F.struct("error", "candidate_id", "timing_resolution_seconds")).alias("b"))
    return best.select("timing_method", "injection_id", "ifo", "b.candidate_id", "b.error", F.col("b.timing_resolution_seconds").alias("resolution"))


def timing_calibration(candidates: DataFrame, arrivals: DataFrame, association: float, quantile: float = 0.99, least: int = 30, most_uncertainty: float = 0.01, most_resolution: float = 0.01) -> DataFrame:
    """For each timing method: matched arrivals out of all (with the Wilson interval), quantiles of the absolute error,
    the largest resolution, and whether matches, resolution and uncertainty (the quantile) are good enough."""
    if association <= 0 or not 0.5 <= quantile < 1 or least <= 0 or most_uncertainty <= 0:
        raise ValueError("association, quantile and limits of a timing calibration are out of range")
    require(failing(candidates, finite=finite("gps_peak", "timing_resolution_seconds")).select("candidate_id", "failed"), "a candidate's timing isn't finite")
    by = timing_matches(candidates, arrivals, association).groupBy("timing_method").agg(
        F.count("*").alias("matches"),
        F.max("resolution").alias("maximum_resolution_seconds"),
        F.percentile("error", F.array(*[F.lit(q) for q in (0.0, 0.5, 0.9, quantile, 1.0)])).alias("q"),
    )
    out = by.withColumn("eligible", arrivals.agg(F.count("*")).scalar())
    low, high = wilson(F.col("matches"), F.col("eligible"))
    gates, passed = all_gates(matches=F.col("matches") >= least, resolution=F.col("maximum_resolution_seconds") <= most_resolution, uncertainty=F.col("q")[3] <= most_uncertainty)
    return out.select(
        "timing_method", "matches", "eligible", (F.col("matches") / F.col("eligible")).alias("match_fraction"), low.alias("match_low"), high.alias("match_high"), "maximum_resolution_seconds",
        *[F.col("q")[i].alias(n) for i, n in enumerate(("error_least", "error_median", "error_p90", "empirical_timing_uncertainty_seconds", "error_largest"))],
        F.lit(quantile).alias("timing_uncertainty_quantile"), gates.alias("gates"), passed.alias("calibration_gate_passed"),
    )


def apply_calibration(candidates: DataFrame, calibration: DataFrame, same_provenance: bool = True) -> DataFrame:
    """Candidates with timing_empirically_calibrated, and uncertainty and quantile of their method if it passed its gates
    and both sides come from the same scoring. Peaks stay as they are, other candidates too. A resolution beyond what
    was calibrated is an error."""
    good = calibration.where(F.col("calibration_gate_passed") & F.lit(same_provenance))
    joined = candidates.join(good.select("timing_method", "maximum_resolution_seconds", "empirical_timing_uncertainty_seconds", "timing_uncertainty_quantile"), "timing_method", "left")
    require(joined.where("timing_resolution_seconds > maximum_resolution_seconds").select("candidate_id"), "a resolution is outside of what was calibrated")
    return joined.withColumn("timing_empirically_calibrated", F.col("maximum_resolution_seconds").isNotNull()).drop("maximum_resolution_seconds")


def annotation_consensus(annotations: DataFrame, task: str, annotator: str, mask: str, required: int) -> DataFrame:
    """Majority mask of each task and the mean and least agreement (Jaccard) of its annotators' pairs. Tasks need an odd
    number of annotators, `required` at least; others aren't returned."""
    require(duplicates(annotations, task, annotator), "an annotator answered a task twice")
    complete = annotations.groupBy(task).agg(F.count("*").alias("panel")).where((F.col("panel") >= required) & (F.col("panel") % 2 == 1))
    rows = annotations.join(complete, task)
    votes = rows.select(task, F.posexplode(mask).alias("pos", "v")).groupBy(task, "pos").agg(F.avg(F.col("v").cast("double")).alias("share"))
    majority = votes.groupBy(task).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("share") >= 0.5).cast("int").alias("v")))), lambda x: x["v"]).alias("majority"))
    a, b = (rows.select(task, F.col(annotator).alias(f"__n{i}"), F.col(mask).alias(f"__m{i}")) for i in (1, 2))
    pairs = a.join(b, task).where("__n1 < __n2")
    both = F.aggregate(F.zip_with("__m1", "__m2", lambda x, y: ((x != 0) & (y != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with("__m1", "__m2", lambda x, y: ((x != 0) | (y != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    agreement = pairs.withColumn("__iou", F.when(either == 0, 1.0).otherwise(both / either)).groupBy(task).agg(F.avg("__iou").alias("mean_iou"), F.min("__iou").alias("least_iou"))
    return complete.join(majority, task).join(agreement, task, "left")


def rule_grid(pairs: DataFrame, rules: Sequence[tuple], parent: str, features: Sequence[str], label: str, ordinal: str) -> DataFrame:
    """For each rule (name, a weight for each feature): share of parents whose best pair is right. Rules are parameters
    and go along as an array; scores are rounded to nine digits, so that sums in another order tie alike."""
    grid = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.array(*[F.lit(float(w)) for w in r[1:]]).alias("w")) for r in rules])
    scored = pairs.withColumn("__r", F.explode(grid)).withColumn("rule", F.col("__r.rule"))
    scored = scored.withColumn("__s", F.round(sum(F.col(f) * F.col("__r.w")[i] for i, f in enumerate(features)), 9))
    best = Window.partitionBy("rule", parent).orderBy(F.desc("__s"), ordinal)
    top = scored.withColumn("__nth", F.row_number().over(best)).where("__nth = 1")
    return top.groupBy("rule").agg(F.count("*").alias("parents"), F.avg(F.col(label).cast("int")).alias("top_1"))


def override_crop(rows: DataFrame, overrides: DataFrame, key: str, values: str, first: str, digest: str | None = None) -> DataFrame:
    """Values with the crop that starts at `first` (from 0) replaced where there is an override; the rest stays. With
    `digest` an override must name the digest of the row that it was made for. Two overrides of a row are an error, and
    so are those of no row."""
    require(duplicates(overrides, key), "a row has two overrides")
    require(missing_references(overrides, rows, key), "an override belongs to no row")
    o = overrides.select(key, F.col(values).alias("__crop"), *([F.col(digest).alias("__digest")] if digest else []))
    joined = rows.join(o, key, "left")
    if digest:
        require(joined.where(F.col("__crop").isNotNull() & ~F.col(digest).eqNullSafe(F.col("__digest"))).select(key), "an override was made for other values")
    size = F.size("__crop")
    new = F.concat(F.slice(values, F.lit(1), F.col(first)), F.col("__crop"), F.slice(values, F.col(first) + size + 1, F.greatest(F.lit(0), F.size(values) - F.col(first) - size)))
    return joined.withColumn(values, F.when(F.col("__crop").isNotNull(), new).otherwise(F.col(values))).drop("__crop", "__digest")


def conditions_side_by_side(df: DataFrame, keys: Sequence[str], condition: str, wanted: Sequence[str], value: str, across: str | None = None) -> DataFrame:
    """One row for each key with a column for each condition. A key that lacks a condition or has one twice is an error;
    with `across` (one of the keys, as a backend) so is a rest of a key that not all of its values have."""
    require(duplicates(df, *keys, condition), "a key has a condition twice")
    out = df.groupBy(*keys).pivot(condition, list(wanted)).agg(F.first(value))
    require(out.where(" or ".join(f"`{c}` is null" for c in wanted)), "a key lacks a condition")
    if across:
        rest = [k for k in keys if k != across]
        n = out.select(across).distinct().count()
        require(out.groupBy(*rest).agg(F.count("*").alias("n")).where(F.col("n") != n), f"a key isn't there for every {across}")
    return out


def score_rows(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A model over batches of rows: `load` runs once in each task and returns batch -> rows (one, none or many each)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def merge_shards(shards: Sequence[DataFrame], identity: Sequence[str], key: str, block: str, split: str, ranges: Sequence[tuple[int, int]] | None = None, detectors: tuple[str, str] | None = None, least: int = 2) -> DataFrame:
    """Shards of one identity as one table: common identity columns, unique keys, no block in two splits, and (where the
    half-open ranges of the shards are given) no range that is empty or overlaps another. With `detectors`, the columns of
    a row's own detector and of its set, a set must name `least` detectors or more, each once, its row's among them."""
    if ranges is not None:
        order = sorted(ranges)
        if any(a >= b for a, b in order) or any(b[0] < a[1] for a, b in zip(order, order[1:], strict=False)):
            raise ContractError("ranges of shards overlap or are empty")
    out = reduce(DataFrame.unionByName, shards)
    require(uncontrolled(out, *identity), "shards differ in their identity")
    require(duplicates(out, key), "a row is in two shards")
    require(broken_dependency(out, block, split), "a block is in two splits")
    if detectors is not None:
        own, names = F.col(detectors[0]), F.col(detectors[1])
        checks = {"once": F.size(F.array_distinct(names)) == F.size(names), "enough": F.size(names) >= least, "named": ~F.array_contains(F.transform(names, lambda x: x.isNull()), True), "own": F.array_contains(names, own)}
        require(failing(out, **checks).select(key, "failed"), "a row's set of detectors is wrong")
    return out
