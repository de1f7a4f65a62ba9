"""Coincidence search: time slides, block permutations, candidate pairs, rankings, coverage and exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from skylattice.contracts import failing, missing_references, require
from skylattice.functions.columns import interval_distance, network_rank, time_key
from skylattice.plans.intervals import chain_clusters
from skylattice.plans.ranking import ranked, running_sums, with_each
from skylattice.plans.selection import prefix_to_target


def slide_table(spark: SparkSession, first: int, last: int, step: int) -> DataFrame:
    """(slide, offset) for slides first..last; a small literal table."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("slide"), (F.col("id") * step).alias("offset"))


def window_slides(triggers: DataFrame, slides: DataFrame, reference: str, shifted: str, band: float | None = None) -> DataFrame:
    """Shifted self-join of scored windows (window_id, gps_start, gps_end, valid_ifos, chirp_scores, peak_times).

    Every window must have both detectors. All pairs count as exposure; `in_band` says whether the peaks, shifted back,
    lie within the band (inclusive), and only such pairs are candidates.
    """
    require(failing(triggers, reference=F.array_contains("valid_ifos", reference), shifted=F.array_contains("valid_ifos", shifted)).select("window_id", "failed"), "a window lacks a detector")
    keyed = triggers.withColumn("__key", time_key(F.col("gps_start").cast("double")))
    peak = lambda ifo: F.try_element_at(F.try_element_at(F.col("peak_times"), F.lit("chirp")), F.lit(ifo))["gps"]
    a = keyed.select("__key", F.col("window_id").alias("reference_window"), "gps_start", "gps_end", F.try_element_at("chirp_scores", F.lit(reference)).alias("score_a"), peak(reference).alias("peak_a"))
    b = keyed.select(F.col("__key").alias("__to"), F.col("window_id").alias("shifted_window"), F.try_element_at("chirp_scores", F.lit(shifted)).alias("score_b"), peak(shifted).alias("peak_b"))
    moved = with_each(a, slides).withColumn("__to", F.col("__key") + time_key(F.col("offset").cast("double")))
    pairs = moved.join(b, "__to").drop("__key", "__to")
    inside = F.lit(True) if band is None else F.coalesce(F.abs(F.col("peak_a") - (F.col("peak_b") - F.col("offset"))) <= band, F.lit(False))
    return pairs.withColumn("ranking_score", network_rank(F.array("score_a", "score_b"))).withColumn("in_band", inside)


def window_pairs(windows: DataFrame, slides: DataFrame, reference: str, shifted: str) -> DataFrame:
    """Pairs (slide, offset, a_window, b_window, start, end) with the detectors they need; others are left out."""
    keyed = windows.withColumn("__key", time_key(F.col("gps_start").cast("double")))
    a = keyed.where(F.array_contains("ifos", reference)).select("__key", F.col("window_id").alias("a_window"), "gps_start", "gps_end")
    b = keyed.where(F.array_contains("ifos", shifted)).select(F.col("__key").alias("__to"), F.col("window_id").alias("b_window"))
    moved = with_each(a, slides).withColumn("__to", F.col("__key") + time_key(F.col("offset").cast("double")))
    return moved.join(b, "__to").drop("__key", "__to")


def slide_exposure(pairs: DataFrame) -> DataFrame:
    """Pairs and live time of each slide, counted before any candidate is looked at."""
    from skylattice.plans.intervals import interval_union

    out = interval_union(pairs, ["slide"], "gps_start", "gps_end")
    return out.select("slide", F.col("intervals").alias("paired_windows"), F.col("union_length").alias("exposure"))


def slide_coincidences(pairs: DataFrame, candidates: DataFrame, reference: str, shifted: str, band: float, gap: float) -> DataFrame:
    """Candidate pairs of paired windows within the band, chained per slide; `best` marks a cluster's representative.

    The window pair is the equi-key of both candidate joins; the band is a residual condition.
    """
    a = candidates.where(F.col("ifo") == reference).select(F.col("window_id").alias("a_window"), F.col("candidate_id").alias("a_id"), F.col("gps_peak").alias("a_peak"), F.col("score").alias("a_score"))
    b = candidates.where(F.col("ifo") == shifted).select(F.col("window_id").alias("b_window"), F.col("candidate_id").alias("b_id"), F.col("gps_peak").alias("b_peak"), F.col("score").alias("b_score"))
    met = pairs.join(a, "a_window").join(b, "b_window").where(F.abs(F.col("a_peak") - (F.col("b_peak") - F.col("offset"))) <= band)
    met = met.withColumn("ranking_score", F.least("a_score", "b_score")).withColumn("event_id", F.concat_ws(":", "slide", "a_id", "b_id"))
    return chain_clusters(met, ["slide"], "a_peak", "ranking_score", gap, "event_id")


def slide_totals(pairs: DataFrame, candidates: DataFrame, reference: str, shifted: str, band: int, gap: int) -> DataFrame:
    """(slide, pairs, clusters, total) of what `slide_coincidences` lists: the number of pairs and of clusters and the sum
    of the clusters' best scores, without a row for each pair. Slides without pairs are left out. Peaks, offsets, band and
    gap are whole numbers.

    Candidates of a window at one time are one row; the best of all pairs of two such rows follows from their own. A shifted
    row is met from peak - band to peak + band. Time is cut into blocks of that length, so that begin and end are in
    neighbouring blocks: what a reference row meets has begun in its block up to it, or is to end there, which are running
    values in two orders. Reference rows that met any are combined by cells that the gap spans; only cells are chained.
    """
    if not all(isinstance(t, IntegralType) for t in (candidates.schema["gps_peak"].dataType, pairs.schema["offset"].dataType)) or not all(isinstance(x, int) and x >= 0 for x in (band, gap)):
        raise ValueError("peaks, offsets, band and gap must be whole numbers")
    cut = lambda t, width: t - F.pmod(t, F.lit(width))
    best = [F.max("score").alias("best"), F.count("*").alias("n"), F.bool_or(F.col("score").isNull()).alias("lone")]
    at = lambda ifo: candidates.where((F.col("ifo") == ifo) & F.col("gps_peak").isNotNull()).groupBy("window_id", F.col("gps_peak").cast("bigint").alias("t")).agg(*best)
    a = at(reference).withColumnRenamed("window_id", "a_window").join(pairs, "a_window").select("best", "b_window", (F.col("t") + F.col("offset")).alias("u"), F.lit(0).alias("side"), "n", "lone", "slide", "offset")
    edge = lambda u, side: F.struct(u.alias("u"), F.lit(side).alias("side"))
    b = at(shifted).withColumn("edge", F.explode(F.array(edge(F.col("t") - band, 1), edge(F.col("t") + band, 2)))).select("best", F.col("window_id").alias("b_window"), "edge.*", "n", "lone")
    # The block isn't shuffled, only what it is made of; an end counts in the block of the first time behind it.
    block = cut(F.col("u") + F.shiftright("side", 1), 2 * band + 1)
    rows = a.unionByName(b, allowMissingColumns=True).repartition("b_window", block).withColumn("block", block)
    for side, order in ((1, F.asc("u")), (2, F.desc("u"))):
        of = lambda c, side=side: F.when(F.col("side") == side, F.col(c))
        upto = Window.partitionBy("b_window", "block").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"n{side}": F.coalesce(F.sum(of("n")).over(upto), F.lit(0)), f"best{side}": F.max(of("best")).over(upto), f"lone{side}": F.coalesce(F.bool_or(of("lone")).over(upto), F.lit(False))})
    other = F.greatest("best1", "best2")
    # A pair with one null has the other's score.
    own = F.when(F.col("best").isNotNull(), F.when(F.col("lone1") | F.col("lone2"), F.col("best")).otherwise(F.least("best", other)))
    met = rows.where("side = 0 and n1 + n2 > 0").withColumn("t", F.col("u") - F.col("offset")).withColumn("score", F.greatest(own, F.when(F.col("lone"), other)))
    cells = met.groupBy("b_window", "block", "slide", cut(F.col("t"), gap + 1)).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum(F.col("n") * (F.col("n1") + F.col("n2"))).alias("pairs"), F.max("score").alias("score"))
    by = Window.partitionBy("slide").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("first") - reach > gap).cast("bigint"), F.lit(1))
    chained = cells.withColumn("new", new).withColumn("cluster", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = chained.groupBy("slide", "cluster").agg(F.sum("pairs").alias("pairs"), F.max("score").alias("score"))
    return clusters.groupBy("slide").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("clusters"), F.sum("score").alias("total"))


def block_permutation_pairs(windows: DataFrame, shifts: DataFrame, reference: str, shifted: str, block_start: Column) -> DataFrame:
    """Block i with block (i + shift) mod n at the same place within the block (shift is the table's column)."""
    at = windows.withColumn("__block", block_start).withColumn("slot", F.col("gps_start") - F.col("__block"))
    numbered = ranked(windows.sparkSession, at.select("__block").distinct(), ["__block"], "index")
    n = numbered.count()
    at = at.join(numbered, "__block")
    a = at.where(F.array_contains("ifos", reference)).select("index", "slot", F.col("window_id").alias("a_window"), (F.col("gps_end") - F.col("gps_start")).alias("duration"))
    b = at.where(F.array_contains("ifos", shifted)).select(F.col("index").alias("__to"), "slot", F.col("window_id").alias("b_window"))
    return with_each(a, shifts).withColumn("__to", F.pmod(F.col("index") + F.col("shift"), F.lit(max(n, 1)))).join(b, ["__to", "slot"]).drop("__to")


def exposure_schedule(exposure: DataFrame, key: str, target: float) -> DataFrame:
    """The shortest ordered list of slides or shifts with exposure whose sum reaches the target."""
    return prefix_to_target(exposure.where("exposure > 0").withColumn("__all", F.lit(0)), ["__all"], [key], "exposure", target).drop("__all")


def prefix_pair_count(windows: DataFrame, keys: list[str], order: str, first: str, second: str) -> DataFrame:
    """How many pairs i < j have `first` at i and `second` at j: a running count, not a self-join, of keys of any size."""
    rows = windows.select(*keys, order, F.coalesce(F.col(first).cast("bigint"), F.lit(0)).alias("__first"), F.col(second).alias("__second"))
    upto = running_sums(rows, keys, order, {"__upto": "__first"})
    return upto.groupBy(*keys).agg(F.sum(F.when(F.col("__second"), F.col("__upto") - F.col("__first")).otherwise(0)).alias("pairs"))


def proposal_coverage(arrivals: DataFrame, proposals: DataFrame, padding: float) -> DataFrame:
    """Each (injection_id, ifo, arrival) with whether any proposal is there, holds the arrival, or holds it when padded;
    arrivals without a proposal stay as misses."""
    require(missing_references(proposals, arrivals, "injection_id"), "proposals of unknown injections")
    joined = arrivals.join(proposals, ["injection_id", "ifo"], "left")
    inside = (F.col("gps_start") <= F.col("arrival")) & (F.col("arrival") <= F.col("gps_end"))
    padded = (F.col("gps_start") - padding <= F.col("arrival")) & (F.col("arrival") <= F.col("gps_end") + padding)
    return joined.groupBy(*arrivals.columns).agg(
        F.count("gps_start").alias("proposals"),
        F.coalesce(F.bool_or(inside), F.lit(False)).alias("inside"),
        F.coalesce(F.bool_or(padded), F.lit(False)).alias("padded"),
        F.min(interval_distance(F.col("arrival"), F.col("gps_start"), F.col("gps_end"))).alias("distance"),
        (F.max(F.col("gps_end")) - F.min(F.col("gps_start"))).alias("span"),
    )


def injection_rankings(injections: DataFrame, candidates: DataFrame, first: str, second: str, delay: float, uncertainty: float, association: float, provenance: Sequence[str] = ()) -> DataFrame:
    """The best pair of each injection that has both arrivals: candidates near their own arrival and near each other, and
    with the same values (null is one) in the columns of `provenance`, such as the digests of the model and of the input.
    Injections without a pair keep the score 0; those without both arrivals are left out."""
    require(missing_references(candidates, injections, "injection_id"), "candidates of unknown injections")
    arrival = lambda i: F.try_element_at("detector_arrival_gps", F.lit(i))
    eligible = injections.where(arrival(first).isNotNull() & arrival(second).isNotNull()).withColumn("t1", arrival(first)).withColumn("t2", arrival(second))
    one = lambda ifo, n: candidates.where(F.col("ifo") == ifo).select("injection_id", F.col("candidate_id").alias(f"c{n}"), F.col("gps_peak").alias(f"p{n}"), F.col("score").alias(f"s{n}"), F.struct(F.lit(0), *provenance).alias(f"from{n}"))
    pairs = eligible.select("injection_id", "t1", "t2").join(one(first, 1), "injection_id").join(one(second, 2), "injection_id")
    near = (F.abs(F.col("p1") - F.col("t1")) <= association) & (F.abs(F.col("p2") - F.col("t2")) <= association) & (F.abs(F.col("p1") - F.col("p2")) <= delay + 2 * uncertainty) & (F.col("from1") == F.col("from2"))
    score = F.least("s1", "s2")
    best = Window.partitionBy("injection_id").orderBy(F.desc("pair_score"), "c1", "c2")
    top = pairs.where(near).withColumn("pair_score", score).withColumn("__nth", F.row_number().over(best)).where("__nth = 1").select("injection_id", "c1", "c2", "pair_score")
    return eligible.drop("t1", "t2").join(top, "injection_id", "left").withColumn("found_pair", F.col("pair_score").isNotNull()).withColumn("ranking_score", F.coalesce("pair_score", F.lit(0.0))).drop("pair_score")


def retained_at_thresholds(rows: DataFrame, thresholds: list[float], parent: str, score: str, error: str, tolerance: float) -> DataFrame:
    """For each threshold: parents with a retained candidate, how many of their best are within the tolerance, and the
    share of those among them and among all parents."""
    grid = rows.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(score) >= t)))
    best = Window.partitionBy(parent, "threshold").orderBy(F.desc(score), error)
    top = grid.withColumn("__nth", F.row_number().over(best)).where("__nth = 1")
    return top.groupBy("threshold").agg(F.count("*").alias("parents"), F.count_if(F.col(error) <= tolerance).alias("within")).withColumns(
        {"conditional_rate": F.col("within") / F.col("parents"), "unconditional_rate": F.col("within") / rows.agg(F.count_distinct(parent)).scalar()}
    )
