"""Splits, samples, schedules, apportionment, de-duplication and set audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.contracts import duplicates, require
from skylattice.operators.graph import checkpoint
from skylattice.plans.ranking import numbered, ranked, renamed, same_keys


def hash_split(u: Column, first: tuple[str, float], second: tuple[str, float], rest: str = "train") -> Column:
    """A split from a uniform hash: [0, f) first, [f, f + s) second, else the rest. It depends on the row alone, so late
    rows never change earlier ones; it works on streams as it is."""
    return F.when(u < first[1], first[0]).when(u < first[1] + second[1], second[0]).otherwise(rest)


def rank_split(df: DataFrame, key: Column, keys: Sequence[str], validation: float, test: float) -> DataFrame:
    """Splits of balanced size by hash rank within `keys`: the first round(n * v) rows are val, the next round(n * t)
    test; halves round to even."""
    ranked = numbered(df, keys, [key], "__rank", "__n").withColumn("__rank", F.col("__rank") + 1)
    v, t = F.bround(F.col("__n") * validation, 0), F.bround(F.col("__n") * test, 0)
    return ranked.withColumn("split", F.when(F.col("__rank") <= v, "val").when(F.col("__rank") <= v + t, "test").otherwise("train")).drop("__rank", "__n")


def prefix_to_target(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, target: float) -> DataFrame:
    """The shortest ordered prefix whose sum reaches the target, the crossing row included; all if it is never reached."""
    before = F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("sum_before", before).where(F.col("sum_before") < target)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int | Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= k)


def label_deficits(df: DataFrame, label: str, want: int, labels: Sequence[str] = ()) -> DataFrame:
    """label, have, deficit: what each label, and each of `labels` that no row has, lacks of `want` rows. Null labels don't
    count."""
    have = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("have"))
    if labels:
        named = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in dict.fromkeys(labels)])).alias(label))
        have = have.join(named, label, "full_outer").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
    return have.withColumn("deficit", F.greatest(F.lit(0).cast("bigint"), F.lit(want) - F.col("have")))


def keep_last(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """One row for each key, the last by the ingest ordinal."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ordinal)))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def largest_remainder(df: DataFrame, total: int, weight: str, tie: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Whole shares of `total` by weight; what flooring leaves goes to the largest remainders, then by `tie`."""
    all_rows = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(all_rows)
    rows = df.withColumn("__exact", exact).withColumn("__whole", F.floor("__exact").cast("bigint"))
    nth = F.row_number().over(all_rows.orderBy(F.desc(F.round(F.col("__exact") - F.col("__whole"), 9)), tie))
    left = F.lit(total) - F.sum("__whole").over(all_rows)
    return rows.withColumn("allocated", F.col("__whole") + (nth <= left).cast("bigint")).drop("__exact", "__whole")


def stratified_buckets(df: DataFrame, order: Sequence, buckets: int, hash_key: Column, keys: Sequence[str]) -> DataFrame:
    """Positions 0..n-1 are cut into buckets at floor(i * n / buckets); the row with the smallest hash of each stays."""
    rows = numbered(df, keys, order, "__i", "__n")
    # the bucket of position i is the largest b with floor(b * n / buckets) <= i
    rows = rows.withColumn("bucket", F.floor(((F.col("__i") + 1) * buckets - 1) / F.col("__n")).cast("bigint"))
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(hash_key))).where("__nth = 1").drop("__i", "__n", "__nth")


def nested_samples(df: DataFrame, keys: Sequence[str], hash_key: Column, scales: Sequence[float]) -> DataFrame:
    """Samples of growing share within strata; each holds the ones before it (hash order doesn't change)."""
    rows = numbered(df, keys, [hash_key], "__rank", "__n")
    return rows.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).where(F.col("__rank") < F.ceil(F.col("__n") * F.col("scale"))).drop("__rank", "__n")


def allocated_strata(strata: DataFrame, keys: Sequence[str], scales: Sequence[int]) -> DataFrame:
    """strata (keys, n rows each) with `counts`: how many rows each scale, from small to large, takes of each stratum.

    A scale gives rows one by one to the stratum that lacks most of its share (scale * n / all rows, less what it has);
    equal ones to the stratum that has fewest, then to the last by its keys. It begins with what the scale before has, so
    scales are nested. The steps aren't gone through: a stratum's next rows lack one less each, so a scale takes all rows
    that lack more than some whole number, which two or three aggregates find, and of the next row of each stratum the
    best by a sort. Only counts pass through the driver.
    """
    spark, scales = strata.sparkSession, sorted(set(scales))
    total = strata.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not scales or scales[0] <= 0 or scales[-1] > total:
        raise ValueError("scales must be positive and no larger than the table")
    rows = checkpoint(spark, strata.select(*keys, F.col("n").cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("counts"), F.lit(0).cast("bigint").alias("have")))
    before = 0
    for scale in scales:
        quota = F.lit(scale) * F.col("n") / F.lit(total)
        # rows that lack more than t are those up to ceil(quota) - t
        upto = lambda t: F.greatest("have", F.least("n", F.ceil(quota) - t))  # noqa: E731, B023
        t = 1
        while rows.agg(F.sum(upto(t) - F.col("have"))).first()[0] > scale - before:
            t += 1
        while rows.agg(F.sum(upto(t - 1) - F.col("have"))).first()[0] <= scale - before and t > -1:
            t -= 1
        rows = checkpoint(spark, rows.withColumn("have", upto(t).cast("bigint")))
        rest = scale - rows.agg(F.sum("have")).first()[0]
        nearest = rows.where("have < n").orderBy(F.desc(quota - F.col("have")), "have", *[F.desc(k) for k in keys]).limit(rest)
        more = nearest.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.lit(1).alias("__more"))
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
        rows = rows.join(more, same, "left").withColumn("have", F.col("have") + F.coalesce("__more", F.lit(0)))
        rows = checkpoint(spark, rows.select(*keys, "n", F.concat("counts", F.array("have")).alias("counts"), "have"))
        before = scale
    return rows.drop("have")


def nested_scales(df: DataFrame, keys: Sequence[str], identity: str, seed: object, scales: Sequence[int]) -> DataFrame:
    """Rows of nested samples of exactly these sizes, with `scale`: `allocated_strata` says how many of each stratum, and
    a stratum's rows come in the order of sha256("seed:identity"), then the identity. A row is there once for each scale
    that holds it. A stratum may hold any share of the rows (see `numbered`).
    """
    scales = sorted(set(scales))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string")), 256)
    rows = numbered(df.withColumn("__h", key), keys, ["__h", identity], "__at", "__n").drop("__h", "__n")
    strata = renamed(allocated_strata(df.groupBy(*keys).agg(F.count("*").alias("n")), keys, scales).drop("n"), keys)
    held = F.filter(F.array(*[F.lit(s).cast("bigint") for s in scales]), lambda _, i: F.col("counts")[i] > F.col("__at"))
    return rows.join(strata, same_keys(rows, strata, keys)).withColumn("scale", F.explode(held)).select(*df.columns, "scale")


def inverse_frequency_weights(df: DataFrame, label: str, exponent: float = 1.0, most_ratio: float | None = None) -> DataFrame:
    """Weight count ** -exponent of each row's label, at most `most_ratio` times the smallest, with mean 1 over rows.

    Labels are counted with a combining aggregate and joined back; only the table of labels is windowed.
    """
    labels = df.groupBy(label).agg(F.count("*").alias("__n"))
    labels = labels.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(-exponent)))
    if most_ratio is not None:
        labels = labels.withColumn("__w", F.least("__w", F.min("__w").over(Window.partitionBy(F.lit(0))) * most_ratio))
    mean = F.sum(F.col("__w") * F.col("__n")).over(Window.partitionBy(F.lit(0))) / F.sum("__n").over(Window.partitionBy(F.lit(0)))
    return df.join(labels.withColumn("sample_weight", F.col("__w") / mean).drop("__n", "__w"), label)


def split_overlaps(df: DataFrame, split: str, axes: Sequence[str]) -> DataFrame:
    """Values of each axis that occur in more than one split: (axis, value, splits)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    long = df.select(split, F.explode(pairs).alias("x")).select(split, "x.axis", "x.value").where("value is not null")
    return long.groupBy("axis", "value").agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def without_held_blocks(df: DataFrame, block: str, held: Column) -> DataFrame:
    """Rows of blocks that hold no held-out row; whole blocks go."""
    return df.join(df.where(held).select(block).distinct(), block, "left_anti")


def best_checkpoint(metrics: DataFrame, index: DataFrame, value: str, largest: bool = False, skip: str = "last.ckpt") -> DataFrame:
    """The checkpoint of the best validation row: epoch, step, value, path, rule.

    metrics (epoch, step, value) may not repeat an epoch and step; index (epoch, step, path). Ties go to the earlier row.
    The checkpoint of the same epoch and step is taken, else the only one of that epoch; files named `skip` don't count.
    """
    rows = metrics.where(F.col(value).isNotNull() & ~F.isnan(value))
    require(duplicates(rows, "epoch", "step"), "an epoch and step is there twice")
    order = F.desc(value) if largest else F.asc(value)
    best = rows.orderBy(order, "epoch", "step").limit(1).select("epoch", F.col("step").alias("best_step"), F.col(value).alias("value"))
    files = index.where(~F.col("path").endswith(f"/{skip}") & (F.col("path") != skip))
    near = files.join(best, "epoch").withColumn("exact", F.col("step") == F.col("best_step"))
    by = near.groupBy("epoch", "best_step", "value").agg(F.max(F.when(F.col("exact"), F.col("path"))).alias("same"), F.count_if("exact").alias("n_same"), F.count("*").alias("n"), F.max("path").alias("only"))
    found = by.where("n_same = 1 or (n_same = 0 and n = 1)")
    require(best.join(found.select("epoch"), "epoch", "left_anti"), "no checkpoint belongs to the best row alone")
    rule = F.when(F.col("n_same") == 1, "exact_epoch_and_global_step").otherwise("unique_checkpoint_for_validation_epoch")
    return found.select("epoch", F.col("best_step").alias("step"), "value", F.coalesce("same", "only").alias("path"), rule.alias("rule"))


def composition_gaps(groups: DataFrame, target: int, shares: Mapping[str, float]) -> DataFrame:
    """composition, target, current, gap: groups that a target of `target` groups with these shares still lacks. Counts
    are whole, the rest goes to the largest remainders, the first in order among equals."""
    exact = {k: target * v / sum(shares.values()) for k, v in shares.items()}
    counts = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: counts[k] - exact[k])[: target - sum(counts.values())]:
        counts[k] += 1
    wanted = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in counts]), F.array(*[F.lit(n) for n in counts.values()])))
    goal = groups.sparkSession.range(1).select(wanted.alias("composition", "target"))
    have = groups.groupBy("composition").agg(F.count("*").alias("current"))
    out = goal.join(have, "composition", "left").withColumn("current", F.coalesce("current", F.lit(0)))
    return out.withColumn("gap", F.greatest(F.lit(0), F.col("target") - F.col("current")))


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of shards; the caller checks `contracts.duplicates` on the keys."""
    return reduce(DataFrame.unionByName, shards)


def positional_slice(df: DataFrame, order: Sequence, index: int, size: int, keys: Sequence[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("position", nth).where((F.col("position") >= index * size) & (F.col("position") < (index + 1) * size))


def shard_ids(spark: SparkSession, df: DataFrame, key: Column, per_shard: int) -> DataFrame:
    """Shard numbers by the order of a key; rows of one key stay together. Keys are ranked as a table of their own."""
    at = ranked(spark, df.select(key.alias("__k")).distinct(), ["__k"], "__rank").withColumn("shard", F.floor(F.col("__rank") / per_shard)).drop("__rank")
    return df.withColumn("__k", key).join(at, "__k").drop("__k")


def quota_bins(spark: SparkSession, df: DataFrame, identity: str, bins: Sequence[tuple[float, float, float]], seed: int) -> DataFrame:
    """Each row with a bin (lower, upper, share) of an exact quota and a log-uniform target in it: `bin`, `target`.

    Counts are the whole parts of the shares, the rest by largest remainder (the first bin among equals). Rows take the
    bins one after the other in the order of a hash of their identity, which ranges give without a window over all rows.
    """
    if any(lo <= 0 or hi <= lo or share <= 0 for lo, hi, share in bins) or any(b[0] < a[1] for a, b in zip(bins, bins[1:], strict=False)):
        raise ValueError("bins must be positive, in order, and apart")
    n, total = df.count(), sum(b[2] for b in bins)
    exact = [n * b[2] / total for b in bins]
    counts = [int(x) for x in exact]
    for i in sorted(range(len(bins)), key=lambda i: (counts[i] - exact[i], i))[: n - sum(counts)]:
        counts[i] += 1
    text = lambda purpose: F.concat(F.lit(f'"{seed}:'), F.col(identity).cast("string"), F.lit(f':{purpose}"'))
    rows = ranked(spark, df.withColumn("__h", F.sha2(text("snr-quota-assignment"), 256)), ["__h", identity], "__rank").drop("__h")
    u = F.conv(F.substring(F.sha2(text("snr-quota-target"), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out, target, first = F.lit(None).cast("string"), F.lit(None).cast("double"), 0
    for (lo, hi, _), k in zip(bins, counts, strict=True):
        here = (F.col("__rank") >= first) & (F.col("__rank") < first + k)
        out, target, first = F.when(here, f"{lo:g}-{hi:g}").otherwise(out), F.when(here, lo * F.pow(F.lit(hi / lo), u)).otherwise(target), first + k
    return rows.withColumn("bin", out).withColumn("target", target).drop("__rank")


def positives_and_some(df: DataFrame, keys: Sequence[str], positive: Column, order: Sequence, k: int | None) -> DataFrame:
    """All positive rows, and of the others the first k of each key."""
    marked = df.withColumn("__p", F.coalesce(positive, F.lit(False)))
    if k is None:
        return marked.drop("__p")
    nth = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order))
    return marked.withColumn("__nth", nth).where(F.col("__p") | (F.col("__nth") <= k)).drop("__p", "__nth")


def best_qualified(df: DataFrame, qualified: Column, order: Sequence) -> DataFrame:
    """The first row that qualifies in an order of several columns; none if none does."""
    return df.where(qualified).orderBy(*order).limit(1)


def first_passing(df: DataFrame, order: Sequence, gate: Column, score: str) -> DataFrame:
    """The first row that passes a gate, else the one with the highest score."""
    return df.orderBy(F.desc(F.coalesce(gate, F.lit(False)).cast("int")), F.when(gate, F.lit(0)).otherwise(-F.col(score)), *order).limit(1)
