"""Evaluation of searches: resampled intervals, paired comparisons, endpoints, arms, thresholds, timing, rates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.contracts import ContractError, duplicates, failing, missing_references, require, uncontrolled
from skylattice.functions.columns import all_gates, ratio_or_nan, wilson, zero_count_limit
from skylattice.operators import stats
from skylattice.operators.resampling import resampled
from skylattice.plans.intervals import interval_union
from skylattice.plans.joins import matched, verified

YEAR = 365.25 * 86400


def evaluate_search(background: DataFrame, injections: DataFrame, score: str, weight: Column, threshold: float, live_time: float, row: str, replicates: int = 500, seed: int = 0) -> DataFrame:
    """One row: false alarms and their rate at a frozen threshold (the 90 % limit if there is none), counted and weighted
    efficiency of injections with the Wilson and the resampled interval."""
    require(failing(injections, weight=weight >= 0).select(row), "an injection has a negative weight")
    found = F.coalesce(F.col(score) >= threshold, F.lit(False))
    out = injections.agg(F.count("*").alias("injections"), F.count_if(found).alias("recovered"), F.sum(weight).alias("weight"), F.sum(F.when(found, weight).otherwise(0.0)).alias("recovered_weight"))
    low, high = wilson(F.col("recovered"), F.col("injections"))
    interval = resampled(injections, [], row, F.when(found, weight).otherwise(0.0), weight, replicates, seed)
    alarms = background.agg(F.count_if(F.col(score) >= threshold)).scalar()
    out = out.withColumns({"false_alarms": alarms, "boot_low": interval.select("low").scalar(), "boot_high": interval.select("high").scalar()})
    far = F.col("false_alarms") / live_time
    return out.withColumns({"far": far, "ifar": F.when(far > 0, 1 / far), "far_limit": F.when(F.col("false_alarms") == 0, zero_count_limit(F.lit(live_time))), "efficiency": F.col("recovered") / F.col("injections"), "low": low, "high": high, "weighted_efficiency": F.col("recovered_weight") / F.col("weight")})


def paired_arms(df: DataFrame, a: Column, b: Column, weight: Column, stratum: str, row: str | None = None, replicates: int = 500, seed: int = 0) -> DataFrame:
    """Two arms on the same injections, overall (`stratum` null) and by stratum: weights found by each (a, b are whether
    an arm found a row), the difference, and both weighted efficiencies. With `row`, which identifies an injection, also
    the interval of the difference over resamples of the pairs, of all and of each stratum (boot_low, boot_high)."""
    found = lambda c: F.when(F.coalesce(c, F.lit(False)), weight).otherwise(0.0)
    hit = lambda c: F.sum(found(c))
    out = df.groupingSets([[], [F.col(stratum)]], stratum).agg(F.grouping_id().alias("overall"), F.count("*").alias("injections"), F.sum(weight).alias("weight"), hit(a).alias("weight_a"), hit(b).alias("weight_b"))
    out = out.withColumns({"overall": F.col("overall") == 1, "delta": F.col("weight_b") - F.col("weight_a"), "relative_delta": F.when(F.col("weight_a") > 0, (F.col("weight_b") - F.col("weight_a")) / F.col("weight_a"))})
    out = out.withColumns({f"efficiency_{x}": F.when(F.col("weight") > 0, F.col(f"weight_{x}") / F.col("weight")) for x in "ab"})
    if row is None:
        return out
    change = found(b) - found(a)
    every = resampled(df, [], row, change, None, replicates, seed).select(F.lit(True).alias("__all"), F.lit(None).cast(df.schema[stratum].dataType).alias("__s"), "low", "high")
    each = resampled(df, [stratum], row, change, None, replicates, seed).select(F.lit(False).alias("__all"), F.col(stratum).alias("__s"), "low", "high")
    both = every.unionByName(each)
    return out.join(both, (out["overall"] == both["__all"]) & out[stratum].eqNullSafe(both["__s"]), "left").select(*[out[c] for c in out.columns], F.col("low").alias("boot_low"), F.col("high").alias("boot_high"))


def regressing_strata(arms: DataFrame, margin: float) -> DataFrame:
    """One row: strata, how many lose more weighted efficiency than the margin, and the largest loss."""
    change = F.col("efficiency_b") - F.col("efficiency_a")
    return arms.where("not overall").agg(F.count("*").alias("strata"), F.count_if(change < -margin).alias("regressions"), F.min(change).alias("worst"))


def subset_arms(scores: DataFrame, thresholds: DataFrame, detectors: Sequence[str], reference: Sequence[str], margin: float) -> DataFrame:
    """Each detector subset (`arm`, names joined by +) against the reference arm, on the same injections.

    scores: arm, injection_id, waveform_id, weight, score; thresholds: arm, threshold. Waveforms and weights must agree
    and every arm must have all injections. `passed`: the weight found is no more than `margin` (relative) below the
    reference's; `complete`: whether every subset of two detectors or more is there.
    """
    name = "+".join(reference)
    ref = scores.where(F.col("arm") == name).drop("arm")
    if not ref.take(1):
        raise ContractError("the reference arm isn't there")
    n = ref.count()
    require(scores.groupBy("arm").agg(F.count("*").alias("n")).where(F.col("n") != n), "an arm lacks injections")
    joined = verified(scores.withColumnRenamed("score", "arm_score"), ref, ["injection_id"], equal=["waveform_id"], close=["weight"]).join(thresholds, "arm")
    at = thresholds.where(F.col("arm") == name).select("threshold").scalar()
    hit = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), F.col("weight")).otherwise(0.0))
    out = joined.withColumn("__at", at).groupBy("arm").agg(F.count("*").alias("injections"), hit(F.col("score") >= F.col("__at")).alias("weight_reference"), hit(F.col("arm_score") >= F.col("threshold")).alias("weight_arm"))
    expected = ["+".join(c) for k in range(2, len(detectors) + 1) for c in combinations(detectors, k)]
    there = scores.agg(F.sort_array(F.collect_set("arm"))).scalar()
    relative = F.when(F.col("weight_reference") > 0, F.col("weight_arm") / F.col("weight_reference") - 1)
    return out.withColumns({"relative_delta": relative, "passed": F.coalesce(relative >= -margin, F.lit(False)), "complete": there == F.array(*[F.lit(x) for x in sorted(expected)])})


def compare_runs(baseline: DataFrame, promoted: DataFrame, keys: Sequence[str], same: Sequence[str], score: str, weight: str, stratum: str, thresholds: tuple[float, float], controls: tuple[DataFrame, Sequence[str]] | None = None) -> DataFrame:
    """paired_arms of two runs over the same rows: the same keys on both sides, equal values of `same` and weights, and
    (where a table of runs and its controlled fields are given) one value of each of those."""
    if controls:
        require(uncontrolled(controls[0], *controls[1]), "the runs differ in a controlled field")
    joined = verified(baseline, promoted.select(*keys, *same, weight, F.col(score).alias("__b")), keys, equal=same, close=[weight], complete=True)
    return paired_arms(joined, F.col(score) >= thresholds[0], F.col("__b") >= thresholds[1], F.col(weight), stratum)


def seed_pairs(reports: DataFrame, arms: tuple[str, str], value: str, least: int) -> DataFrame:
    """For each mode (`mode`), arms paired on the seed: pairs, mean and least difference of the second to the first, and
    whether at least `least` seeds have both. A seed that has an arm twice is an error."""
    require(duplicates(reports, "mode", "arm", "seed"), "an arm has a seed twice")
    wide = reports.groupBy("mode", "seed").pivot("arm", list(arms)).agg(F.first(value))
    d = F.col(f"`{arms[1]}`") - F.col(f"`{arms[0]}`")
    out = wide.groupBy("mode").agg(F.count(d).alias("pairs"), F.count_if(d.isNull()).alias("unpaired"), F.avg(d).alias("mean_delta"), F.min(d).alias("least_delta"))
    gates, passed = all_gates(seeds=F.col("pairs") >= least, paired=F.col("unpaired") == 0, better=F.col("mean_delta") > 0)
    return out.withColumn("gates", gates).withColumn("passed", passed)


def scaling_curve(df: DataFrame, keys: Sequence[str], scale: str, value: str, slack: float, least_gain: float) -> DataFrame:
    """Rows by scale with the gain over the smallest scale and the change from the scale before; for the whole curve
    whether it falls by no more than `slack` anywhere, and whether the last gain is enough."""
    by = Window.partitionBy(*keys).orderBy(scale)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumn("gain", F.col(value) - F.first(value).over(by)).withColumn("change", F.col(value) - F.lag(value).over(by))
    out = out.withColumn("nearly_monotonic", F.min(F.coalesce(F.col("change"), F.lit(0.0))).over(whole) >= -slack)
    return out.withColumn("enough", F.last("gain").over(whole) >= least_gain)


def timing_summary(df: DataFrame, peaks: str, truth: str, tolerance: float = 0.01) -> DataFrame:
    """For each detector of a map of peaks, and for their median (`network`): rows, median and 90 % quantile of the
    absolute error, and how many are within the tolerance."""
    values = F.sort_array(F.map_values(peaks))
    n = F.size(values)
    middle = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
    each = df.select(F.explode(F.concat(F.map_entries(peaks), F.array(F.struct(F.lit("network").alias("key"), middle.alias("value"))))).alias("p"), truth)
    error = F.abs(F.col("p.value") - F.col(truth))
    out = each.groupBy(F.col("p.key").alias("detector")).agg(F.count(error).alias("n"), F.percentile(error, F.array(F.lit(0.5), F.lit(0.9))).alias("q"), F.count_if(error <= tolerance).alias("within"))
    return out.select("detector", "n", F.col("q")[0].alias("median_error"), F.col("q")[1].alias("p90_error"), "within", (F.col("within") / F.col("n")).alias("within_rate"))


def threshold_scan(df: DataFrame, grid: Sequence[float], score: str, label: Column) -> DataFrame:
    """threshold, tp, fp, fn, iou, precision, recall for each threshold of a grid, and `selected`, the first with the best
    iou. Rows are counted once, by how many thresholds they reach; only those counts meet the grid."""
    steps = sorted(grid)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in steps]), lambda t: t <= F.col(score)))
    counts = df.groupBy(reached.alias("reached")).agg(F.count_if(label).alias("p"), F.count_if(~F.coalesce(label, F.lit(False))).alias("q"))
    rows = counts.select("p", "q", "reached", F.posexplode(F.array(*[F.lit(float(t)) for t in steps])).alias("i", "threshold"))
    over = F.col("reached") > F.col("i")
    sums = rows.groupBy("i", "threshold").agg(F.sum(F.when(over, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("q")).otherwise(0)).alias("fp"), F.sum(F.when(~over, F.col("p")).otherwise(0)).alias("fn"))
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    out = sums.withColumns({"iou": share(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), "precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    order = {float(t): i for i, t in reversed(list(enumerate(grid)))}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    nth = F.row_number().over(Window.orderBy(F.desc("iou"), F.element_at(place, F.col("threshold"))))  # a row for each threshold
    return out.withColumn("selected", nth == 1).drop("i")


def endpoint(background: DataFrame, injections: DataFrame, score: str, weight: Column, family: str, most_alarms: int) -> DataFrame:
    """Overall (`family` null) and by family: efficiency at the threshold that `most_alarms` background windows reach at
    most; live time is the union of the windows, and ids must be unique."""
    require(duplicates(background, "window_id"), "a background window is there twice")
    require(duplicates(injections, "injection_id"), "an injection is there twice")
    require(failing(background, interval=F.col("gps_end") > F.col("gps_start")).select("window_id"), "a window has no length")
    cut = stats.threshold_at_count(background.withColumn("__k", F.lit(0)), ["__k"], score, most_alarms)
    live = interval_union(background.withColumn("__k", F.lit(0)), ["__k"], "gps_start", "gps_end").select("union_length").scalar()
    rows = injections.withColumn("__t", cut.select("threshold").scalar())
    found = F.coalesce(F.col(score) >= F.col("__t"), F.lit(False))
    out = rows.groupingSets([[], [F.col(family)]], family).agg(F.grouping_id().alias("overall"), F.count("*").alias("n"), F.count_if(found).alias("found"), F.sum(weight).alias("weight"), F.sum(F.when(found, weight).otherwise(0.0)).alias("weight_found"), F.first("__t").alias("threshold"))
    low, high = wilson(F.col("found"), F.col("n"))
    return out.withColumns({"overall": F.col("overall") == 1, "efficiency": F.col("weight_found") / F.col("weight"), "low": low, "high": high, "live_time": live, "false_alarms": cut.select("survivors").scalar()})


def detector_exposure(windows: DataFrame, start: str, end: str, ifos: str, keys: Sequence[str] = ()) -> DataFrame:
    """Union of the windows of each detector: keys, ifo, exposure."""
    each = windows.select(*keys, F.explode(ifos).alias("ifo"), start, end)
    return interval_union(each, [*keys, "ifo"], start, end).select(*keys, "ifo", F.col("union_length").alias("exposure"))


def detector_rates(windows: DataFrame, candidates: DataFrame, score: str, target: float, year: float = YEAR) -> DataFrame:
    """Rates of single detectors at one threshold, which gives `target` candidates a detector-year at most: ifo, exposure,
    survivors, rate, rate_limit (90 %, where there is none), threshold. A candidate needs a window with its detector."""
    require(duplicates(windows, "window_id"), "a window is there twice")
    pairs = windows.select("window_id", F.explode("ifos").alias("ifo"))
    require(missing_references(candidates, pairs, "window_id", "ifo"), "a candidate has no window of its detector")
    exposure = detector_exposure(windows, "gps_start", "gps_end", "ifos")
    total = exposure.agg(F.sum("exposure") / year).scalar()
    cut = stats.threshold_at_rate(candidates.withColumn("__k", F.lit(0)).withColumn("__y", total), ["__k", "__y"], score, F.col("__y"), target, windows.limit(1).select(F.lit(0).alias("__k")).withColumn("__y", total))
    over = candidates.withColumn("__t", cut.select("threshold").scalar()).where(F.col(score) >= F.col("__t")).groupBy("ifo").agg(F.count("*").alias("survivors"))
    out = exposure.join(over, "ifo", "left").withColumn("survivors", F.coalesce("survivors", F.lit(0))).withColumn("threshold", cut.select("threshold").scalar())
    years = F.col("exposure") / year
    return out.withColumns({"rate": F.col("survivors") / years, "rate_limit": F.when(F.col("survivors") == 0, zero_count_limit(years))})


def merged_background(windows: DataFrame) -> dict[str, DataFrame]:
    """Audited counters of merged shards: `runs`, `detectors`, `subsets` (names of a set together), and `splits` (windows,
    live time, detector time). Ids and intervals are unique, blocks lie in one split, sets of detectors aren't empty."""
    require(duplicates(windows, "window_id"), "a window is in two shards")
    require(duplicates(windows, "gps_start", "gps_end"), "an interval is in two shards")
    require(windows.groupBy("gps_block").agg(F.count_distinct("split").alias("n")).where("n > 1"), "a block is in two splits")
    require(failing(windows, run=F.col("observing_run") != "", ifos=(F.size("ifos") > 0) & (F.size(F.array_distinct("ifos")) == F.size("ifos"))).select("window_id", "failed"), "a window has no run, or an odd set of detectors")
    count = lambda c, name: windows.groupBy(c.alias(name)).agg(F.count("*").alias("windows"))
    live = interval_union(windows, ["split"], "gps_start", "gps_end").select("split", F.col("intervals").alias("windows"), F.col("union_length").alias("live_time"))
    times = detector_exposure(windows, "gps_start", "gps_end", "ifos", ["split"]).groupBy("split").agg(F.sum("exposure").alias("detector_time"))
    return {
        "runs": count(F.col("observing_run"), "run"),
        "detectors": windows.select(F.explode("ifos").alias("ifo")).groupBy("ifo").agg(F.count("*").alias("windows")),
        "subsets": count(F.array_join("ifos", ""), "subset"),
        "splits": live.join(times, "split"),
    }


def abstention_strata(df: DataFrame, field: str, unknown: str, abstained: str) -> DataFrame:
    """For each value of a field: rows, unknown and known ones, the share of unknown rows that are abstained from (right)
    and of known ones (wrong); null where there are none."""
    u, a = F.col(unknown), F.col(abstained)
    out = df.groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n"), F.count_if(u).alias("unknown_rows"), F.count_if(~u).alias("known_rows"), F.count_if(u & a).alias("__u"), F.count_if(~u & a).alias("__k"))
    rate = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n))
    return out.withColumns({"unknown_true_abstention": rate("__u", "unknown_rows"), "known_false_abstention": rate("__k", "known_rows")}).drop("__u", "__k")


def family_masks(df: DataFrame, family: str, tp: str, fp: str, fn: str) -> DataFrame:
    """Counts of true and false pixels summed by family, with iou, precision and recall (NaN where nothing is there)."""
    require(failing(df, counts=(F.col(tp) >= 0) & (F.col(fp) >= 0) & (F.col(fn) >= 0)).select(family), "a count is negative")
    s = df.groupBy(family).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"))])
    t, f, m = (F.col(c) for c in ("tp", "fp", "fn"))
    return s.withColumns({"iou": ratio_or_nan(t, t + f + m), "precision": ratio_or_nan(t, t + f), "recall": ratio_or_nan(t, t + m)})


def catalog_hits(predictions: DataFrame, catalog: DataFrame, snr: str, hit: str) -> tuple[DataFrame, DataFrame]:
    """One row of counts (images, matched, hits, rate with the Wilson interval over matched images), and the misses of an
    snr of 20 or more, loudest first. predictions: event; catalog: commonName, the last entry of a name counts."""
    rows = matched(predictions, catalog, "event", "commonName")
    s = rows.agg(F.count("*").alias("images"), F.count_if("matched").alias("matches"), F.count_if(F.col("matched") & F.col(hit)).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("matches"))
    summary = s.withColumns({"rate": F.when(F.col("matches") > 0, F.col("hits") / F.col("matches")), "low": low, "high": high})
    return summary, rows.where(F.col("matched") & ~F.col(hit) & (F.col(snr) >= 20)).orderBy(F.desc(snr), "event")
