"""Thresholds, efficiencies, ranks, intervals and fits."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.columns import wilson, zero_count_limit
from skylattice.plans.order_statistics import quantiles, smallest_passed_by
from skylattice.plans.ranking import renamed, running_sums, same_keys, with_each

#: Student's t at 97.5 % by degrees of freedom, fixed values. Between them the next larger degree counts, beyond 30 that
#: of 30.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 15: 2.131, 20: 2.086, 30: 2.042}
#: The threshold that nothing reaches, where there is no background to take it from.
NO_BACKGROUND = sys.float_info.max


def threshold_at_rate(df: DataFrame, keys: Sequence[str], score: str, live_time: Column, target: float, all_keys: DataFrame | None = None) -> DataFrame:
    """Most permissive threshold with survivors / live time <= target. live_time may use the keys. far 0 gives a null
    ifar and the 90 % limit of a zero count. Keys of `all_keys` that have no score get the largest number there is.
    Scores that aren't finite are an error; rows without a score don't count."""
    about = F.floor(live_time * target)
    most = F.when((about + 1) / live_time <= target, about + 1).when(about / live_time <= target, about).otherwise(about - 1)
    out = smallest_passed_by(df, keys, score, most)
    if all_keys is not None:
        wanted, found = all_keys.select(*keys).distinct(), renamed(out, keys)
        out = wanted.join(found, same_keys(wanted, found, keys), "left").select(*keys, F.coalesce("threshold", F.lit(NO_BACKGROUND)).alias("threshold"), F.coalesce("survivors", F.lit(0)).alias("survivors"))
    out = out.withColumn("far", F.col("survivors") / live_time)
    return out.withColumn("ifar", F.when(F.col("far") > 0, 1 / F.col("far"))).withColumn("far_limit", F.when(F.col("far") == 0, zero_count_limit(live_time)))


def threshold_at_count(df: DataFrame, keys: Sequence[str], score: str, most: int) -> DataFrame:
    """Most permissive threshold with at most `most` survivors."""
    return smallest_passed_by(df, keys, score, F.lit(most).cast("bigint"))


def threshold_at_fraction(df: DataFrame, keys: Sequence[str], score: str, fraction: float) -> DataFrame:
    """Most permissive threshold that floor(fraction * n) rows of a key survive at most."""
    return smallest_passed_by(df, keys, score, F.floor(F.col("n") * fraction))


def weighted_efficiency(df: DataFrame, keys: Sequence[str], score: str, weight: Column, threshold: Column | float) -> DataFrame:
    """Share of weight found, counts, and the Wilson interval of the counted share."""
    found = F.coalesce(F.col(score) >= threshold, F.lit(False))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(found).alias("found"), F.sum(weight).alias("weight"), F.sum(F.when(found, weight).otherwise(0.0)).alias("weight_found"))
    low, high = wilson(F.col("found"), F.col("n"))
    return out.withColumn("efficiency", F.col("weight_found") / F.col("weight")).withColumn("low", low).withColumn("high", high)


def grouped_summary(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """GROUPING SETS with a label: which columns a row is grouped by (`overall` for none) and their values."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("__id"), *aggregates)
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    label, value = F.lit("overall"), F.lit("all")
    for s in sets:
        if s:
            hit = F.col("__id") == sum(bit[c] for c in columns if c not in s)
            label = F.when(hit, "+".join(s)).otherwise(label)
            value = F.when(hit, F.concat_ws("+", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in s])).otherwise(value)
    return grouped.withColumn("grouping", label).withColumn("value", value).drop("__id", *columns)


def binned_rates(df: DataFrame, bins: DataFrame, value: str, hit: Column) -> DataFrame:
    """bins (bin, lo, hi), half-open; null values go, empty bins stay with a null rate. Rows are counted per bin before
    the join."""
    counted = with_each(df.where(F.col(value).isNotNull()), bins).where((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))).groupBy("bin").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    out = bins.join(counted, "bin", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))})
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.withColumn("rate", F.when(F.col("n") > 0, F.col("hits") / F.col("n"))).withColumn("low", low).withColumn("high", high)


def auroc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """P(score of a positive > score of a negative), ties one half: exact, from average ranks of distinct scores.
    Rows without a score don't count."""
    distinct = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(label).cast("bigint")).alias("__p"), F.sum(1 - F.col(label).cast("bigint")).alias("__q"))
    upto = running_sums(distinct, keys, score, {"__upto": "__q"})
    wins = upto.withColumn("__w", F.col("__p") * (F.col("__upto") - F.col("__q") / 2))
    out = wins.groupBy(*keys).agg(F.sum("__w").alias("__w"), F.sum("__p").alias("positives"), F.sum("__q").alias("negatives"))
    return out.withColumn("auroc", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("__w") / (F.col("positives") * F.col("negatives")))).drop("__w")


def average_precision(df: DataFrame, keys: Sequence[str], score: str, label: str, ordinal: str) -> DataFrame:
    """Mean precision at the hits, by falling score; ties keep their order. What lies above a score comes from running
    sums over distinct scores, so only rows of one score are ordered together."""
    hit = F.col(label).cast("bigint")
    rows = df.where(F.col(score).isNotNull())
    distinct = running_sums(rows.groupBy(*keys, score).agg(F.count("*").alias("__n"), F.sum(hit).alias("__p")), keys, score, {"__un": "__n", "__up": "__p"}, descending=True)
    above = renamed(distinct.select(*keys, F.col(score).alias("__score"), (F.col("__un") - F.col("__n")).alias("__above"), (F.col("__up") - F.col("__p")).alias("__hits")), keys)
    joined = rows.join(above, same_keys(rows, above, keys) & (F.col(score) == F.col("__score")))
    ties = Window.partitionBy(*keys, score).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("__hits") + F.sum(hit).over(ties)) / (F.col("__above") + F.count("*").over(ties))
    return joined.withColumn("__at", at).groupBy(*keys).agg(F.avg(F.when(hit == 1, F.col("__at"))).alias("average_precision"), F.sum(hit).alias("positives"))


def top_1(df: DataFrame, parent: str, score: str, ordinal: str) -> DataFrame:
    """The row with the highest score of each parent, the first among equals."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(parent).orderBy(F.desc(score), ordinal))).where("__nth = 1").drop("__nth")


def seed_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, sample deviation, Student's interval, least and largest over seeds."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("largest"))
    t = F.lit(T95[30])
    for degrees, x in sorted(T95.items(), reverse=True):
        t = F.when(F.col("n") - 1 <= degrees, x).otherwise(t)
    t = F.when(F.col("n") > 1, t)
    half = t * F.col("deviation") / F.sqrt("n")
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def posterior_metrics(df: DataFrame, keys: Sequence[str], value: str, truth: str, level: float = 0.9) -> DataFrame:
    """mean, median, population deviation, equal-tail interval (interpolated quantiles), coverage, mean distance. Values
    that aren't finite are an error."""
    tail = (1 - level) / 2
    q = renamed(quantiles(df, keys, value, [0.5, tail, 1 - tail]), keys)
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.first(truth).alias("truth"), F.avg(F.abs(F.col(value) - F.col(truth))).alias("distance"))
    out = out.join(q, same_keys(out, q, keys), "left").select(*out.columns, F.col("q0").alias("median"), F.col("q1").alias("low"), F.col("q2").alias("high"))
    return out.withColumn("covered", (F.col("truth") >= F.col("low")) & (F.col("truth") <= F.col("high"))).withColumn("bias", F.col("mean") - F.col("truth"))


def power_law_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, exponents: DataFrame) -> DataFrame:
    """y = c - a * x ** -alpha by least squares over a grid of alpha; a > 0 is asked for, the smallest error wins."""
    grid = with_each(df, exponents).withColumn("__t", F.pow(F.col(x).cast("double"), -F.col("alpha")))
    fits = grid.groupBy(*keys, "alpha").agg(
        F.count("*").alias("n"), F.sum("__t").alias("st"), F.sum(y).alias("sy"), F.sum(F.col("__t") * F.col("__t")).alias("stt"), F.sum(F.col("__t") * F.col(y)).alias("sty"), F.sum(F.col(y) * F.col(y)).alias("syy")
    )
    spread = F.col("stt") - F.col("st") * F.col("st") / F.col("n")
    shared = F.col("sty") - F.col("st") * F.col("sy") / F.col("n")
    slope = shared / spread
    fits = fits.withColumn("slope", slope).withColumn("asymptote", (F.col("sy") - F.col("slope") * F.col("st")) / F.col("n")).withColumn("sse", F.col("syy") - F.col("sy") * F.col("sy") / F.col("n") - F.col("slope") * shared)
    best = Window.partitionBy(*keys).orderBy(F.round("sse", 9), "alpha")
    return fits.where("slope < 0").withColumn("__nth", F.row_number().over(best)).where("__nth = 1").select(*keys, "alpha", "asymptote", (-F.col("slope")).alias("scale"), "sse")


def bootstrap_mean(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, weight: str | None = None, replicates: int = 1000, seed: int = 0, block: int = 256) -> DataFrame:
    """Percentile interval of the mean, with numpy's generator over rows in order, in blocks of replicates.

    With a weight column each resample is divided by its own sampled weight. A key's rows are in one task; aggregate
    first where a key is large.
    """
    columns = [*keys, ordinal, value, *([weight] if weight else [])]
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", n long, mean double, low double, high double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordinal)
        x = pdf[value].to_numpy(float)
        w = pdf[weight].to_numpy(float) if weight else np.ones(len(x))
        rng, means = np.random.default_rng(seed), []
        for at in range(0, replicates, block):
            i = rng.integers(0, len(x), size=(min(block, replicates - at), len(x)))
            means.append(x[i].sum(1) / w[i].sum(1))
        low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
        return pd.DataFrame([[*pdf[list(keys)].iloc[0].tolist(), len(x), x.sum() / w.sum(), low, high]], columns=[*keys, "n", "mean", "low", "high"])

    return df.select(*columns).groupBy(*keys).applyInPandas(run, schema)


def mahalanobis_fit(df: DataFrame, vector: str, label: str, shrinkage: float = 0.1, epsilon: float = 1e-6) -> dict:
    """Centroids and the inverse of the pooled within-class covariance, shrunk to its diagonal.

    Sums per class and sums of products come from one pass of partial sums in each task; only those reach the driver.
    """
    schema = "label string, n long, total array<double>, products array<double>"

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for lab, group in pdf.groupby("label"):
                x = np.stack(group["vector"].to_numpy()).astype(float)
                n, t, p = sums.get(lab, (0, 0, 0))
                sums[lab] = (n + len(x), t + x.sum(0), p + x.T @ x)
        if sums:
            yield pd.DataFrame([(k, n, t.tolist(), p.ravel().tolist()) for k, (n, t, p) in sums.items()], columns=["label", "n", "total", "products"])

    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector")).mapInPandas(partial, schema).collect()
    by: dict = {}
    for r in rows:
        n, t, p = by.get(r["label"], (0, 0, 0))
        by[r["label"]] = (n + r["n"], t + np.array(r["total"]), p + np.array(r["products"]).reshape(len(r["total"]), -1))
    labels = sorted(by)
    centres = np.stack([by[k][1] / by[k][0] for k in labels])
    scatter = sum(by[k][2] - by[k][0] * np.outer(c, c) for k, c in zip(labels, centres, strict=True))
    cov = scatter / max(1, sum(by[k][0] for k in labels) - len(labels))
    cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + epsilon * np.eye(len(cov))
    return {"labels": labels, "centres": centres, "precision": np.linalg.pinv(cov)}


def mahalanobis_scores(df: DataFrame, vector: str, fit: dict) -> DataFrame:
    """Smallest quadratic distance to a centroid, at least 0."""
    centres, precision = fit["centres"], fit["precision"]

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(float)
        best = np.full(len(x), math.inf)
        for c in centres:
            d = x - c
            best = np.minimum(best, np.einsum("ij,jk,ik->i", d, precision, d))
        return pd.Series(np.maximum(best, 0))

    return df.withColumn("score", score(F.col(vector).cast("array<double>")))
