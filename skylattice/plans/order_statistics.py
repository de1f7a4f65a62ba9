"""Exact order statistics of keys of any size: ranges are narrowed by counts, and no key is sorted or held anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.contracts import ContractError
from skylattice.operators.graph import checkpoint
from skylattice.plans.ranking import renamed, same_keys

#: Rows of a range that one task may sort, bins that a range is cut into by width and by a sketch, ranges that are broadcast.
WHOLE, BINS, CUTS, BROADCAST_ROWS = 1_000_000, 4096, 16, 10_000
#: Half the distance from 1 to the next double, a little more than that, and the smallest double.
HALF_ULP, LEAST = 2.0**-53 * (1 + 2.0**-52), 5e-324


def next_double(x: Column) -> Column:
    """The smallest double above a finite one: half a unit in the last place, a trifle more, added and rounded."""
    return x + (F.abs(x) * HALF_ULP + LEAST)


def values_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and the value as double `v`; rows without one go."""
    return df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null")


def totals_of(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """keys, n, lo, hi: how many values, the least and the largest; and the largest n. NaN and infinities are an error."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.isnan("v") | (F.abs("v") == float("inf"))).alias("bad"))
    out = checkpoint(rows.sparkSession, out)
    found = out.agg(F.max("bad").alias("bad"), F.max("n").alias("n")).first()
    if found["bad"]:
        raise ContractError("a value isn't finite")
    return out.drop("bad"), found["n"] or 0


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def order_statistics(rows: DataFrame, totals: DataFrame, keys: Sequence[str], ranks: DataFrame, whole: int = WHOLE, bins: int = BINS) -> DataFrame:
    """keys, rank, value: the rank-th smallest `v` of each key for ranks (keys, rank) from 1 to n.

    Each rank has a range that holds it and the number of values below. A round counts the values of the ranges in bins,
    with the least and the largest value of each bin, and the bin that holds the rank is the next range. Bins have equal
    width; after a round in which a range kept much of what it had (long tails), CUTS quantiles of a sketch part them.
    A range of one value is done; when no range has more than `whole` rows, these are sorted. A round reads the values
    once, or twice with a sketch, and shuffles bins only.
    """
    spark = rows.sparkSession
    wanted, known = ranks.select(*keys, "rank"), renamed(totals.select(*keys, "n", "lo", "hi"), keys)
    state = wanted.join(known, same_keys(wanted, known, keys)).select(*keys, "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below"), "n")
    done, last = None, None
    while True:
        state = checkpoint(spark, state)
        ready = state.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
        done = ready if done is None else done.unionByName(ready)
        state = state.where("lo < hi")
        most = state.agg(F.max("n")).first()[0]
        if most is None:
            return done
        ranges = _small(renamed(state.groupBy(*keys, "lo", "hi", "below").agg(F.collect_list("rank").alias("ranks")), keys))
        inside = rows.join(ranges, same_keys(rows, ranges, keys) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select(*keys, "v", "lo", "hi", "below", "ranks")
        if most <= whole:
            at = F.col("below") + F.row_number().over(Window.partitionBy(*keys, "lo").orderBy("v"))
            found = inside.withColumn("rank", at.cast("bigint")).where(F.array_contains("ranks", F.col("rank"))).select(*keys, "rank", F.col("v").alias("value"))
            return done.unionByName(found)
        if last is not None and most > last / CUTS:
            cuts = inside.groupBy(*keys, "lo").agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 100 * CUTS).alias("cuts"))
            cuts = _small(checkpoint(spark, renamed(cuts.withColumnRenamed("lo", "lo_of"), keys)))
            inside = inside.join(cuts, same_keys(inside, cuts, keys) & (F.col("lo") == F.col("lo_of"))).select(*inside.columns, "cuts")
            bin_of = F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.size(F.filter("cuts", lambda c: c <= F.col("v")))
        else:  # halves, so that the width of a range can't overflow; products of the same positive number keep the order
            share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
            bin_of = F.least(F.floor(share * bins), F.lit(bins - 1))
        last = most
        cells = inside.withColumn("bin", bin_of).groupBy(*keys, "lo", "below", "bin").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("largest"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = renamed(cells.withColumn("under", F.col("below") + before).select(*keys, F.col("lo").alias("lo_of"), "n", "least", "largest", "under"), keys)
        held = (F.col("lo") == F.col("lo_of")) & (F.col("rank") > F.col("under")) & (F.col("rank") <= F.col("under") + cells["n"])
        state = state.drop("n").join(cells, same_keys(state, cells, keys) & held).select(*keys, "rank", F.col("least").alias("lo"), F.col("largest").alias("hi"), F.col("under").alias("below"), "n")


def smallest_passed_by(df: DataFrame, keys: Sequence[str], value: str, most: Column, whole: int = WHOLE) -> DataFrame:
    """keys, threshold, survivors: the smallest value that at most `most` rows of its key reach, or the next double above
    the largest value if there is none. `most` may use the keys and n, the number of values.

    That value is the next one above the (most + 1)-th largest. Where no key has more than `whole` values, one window over
    the distinct values of a key finds it.
    """
    rows = values_of(df, keys, value)
    totals, largest = totals_of(rows, keys)
    budget = totals.withColumn("most", most)
    every = F.col("n") <= F.col("most")
    if largest <= whole:
        upto = Window.partitionBy(*keys).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
        reach, limits = rows.groupBy(*keys, "v").agg(F.count("*").alias("c")).withColumn("reach", F.sum("c").over(upto)), renamed(budget, keys)
        found = reach.join(limits, same_keys(reach, limits, keys)).groupBy(*keys).agg(F.min(F.when(F.col("reach") <= F.col("most"), F.col("v"))).alias("threshold"), F.max(F.when(F.col("reach") <= F.col("most"), F.col("reach"))).alias("survivors"), F.max("hi").alias("hi"))
        return found.select(*keys, F.coalesce("threshold", next_double(F.col("hi"))).alias("threshold"), F.coalesce("survivors", F.lit(0)).cast("bigint").alias("survivors"))
    cut = order_statistics(rows, totals, keys, budget.where("n > most and most >= 0").withColumn("rank", F.col("n") - F.col("most")), whole)
    cut = checkpoint(rows.sparkSession, cut)
    cuts = _small(renamed(cut, keys))
    above = renamed(rows.join(cuts, same_keys(rows, cuts, keys)).where("v > value").groupBy(*keys).agg(F.min("v").alias("threshold"), F.count("*").alias("survivors")), keys)
    out = budget.join(above, same_keys(budget, above, keys), "left")
    return out.select(
        *keys, F.when(every, F.col("lo")).otherwise(F.coalesce("threshold", next_double(F.col("hi")))).alias("threshold"), F.when(every, F.col("n")).otherwise(F.coalesce("survivors", F.lit(0))).cast("bigint").alias("survivors")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], whole: int = WHOLE) -> DataFrame:
    """keys and q0, q1, ...: quantiles at the shares, interpolated between neighbours."""
    rows = values_of(df, keys, value)
    totals, largest = totals_of(rows, keys)
    if largest <= whole:  # a key's values are few enough for one buffer
        out = rows.groupBy(*keys).agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
        return out.select(*keys, *[F.col("q")[i].alias(f"q{i}") for i in range(len(shares))])
    place = totals.select(*keys, F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("i", "share"), "n").withColumn("h", F.col("share") * (F.col("n") - 1))
    place = checkpoint(rows.sparkSession, place.select(*keys, "i", (F.floor("h") + 1).alias("low"), (F.ceil("h") + 1).alias("high"), (F.col("h") - F.floor("h")).alias("part")))
    ranks = place.select(*keys, F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = checkpoint(rows.sparkSession, order_statistics(rows, totals, keys, ranks, whole))
    for side in ("low", "high"):
        one = renamed(found.select(*keys, F.col("rank").alias("r"), F.col("value").alias(f"v_{side}")), keys)
        place = place.join(one, same_keys(place, one, keys) & (F.col(side) == F.col("r"))).select(*place.columns, f"v_{side}")
    at = F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("part")
    return place.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, at)).alias(f"q{i}") for i in range(len(shares))])
