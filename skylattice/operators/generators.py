"""Deterministic generators: scene recipes and injection populations. Draws come from hashes of the row's identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.contracts import require
from skylattice.functions.columns import canonical_hash, hash_uniform, log_uniform, seeded_hash
from skylattice.plans.selection import top_k


def draw(seed: int, name: str, *identity: Column) -> Column:
    """A uniform number that depends on the seed, the parameter's name and the row's identity only."""
    return hash_uniform(seeded_hash(f"{seed}:{name}", *identity))


def scene_recipes(spark: SparkSession, split: str, count: int, types: dict[str, float], detectors: Sequence[str], seed: int, duration: int = 8) -> DataFrame:
    """`count` scenes of a split; types by share (cumulative, in the order given)."""
    i = F.col("id").cast("string")
    rows = spark.range(count).withColumn("split", F.lit(split)).withColumn("__u", draw(seed, "type", F.lit(split), i))
    names, upto = list(types), 0.0
    kind = F.lit(None).cast("string")
    for name in names[:-1]:
        upto += types[name]
        kind = F.coalesce(kind, F.when(F.col("__u") < upto, F.lit(name)))
    kind = F.coalesce(kind, F.lit(names[-1]))
    out = rows.withColumn("scene_type", kind).withColumn("gps_start", (F.lit(1_000_000_000) + F.col("id") * duration).cast("bigint"))
    out = out.withColumn("target_snr", F.when(F.col("scene_type").contains("chirp"), log_uniform(draw(seed, "snr", F.lit(split), i), 4.0, 40.0)))
    out = out.withColumn("ifos", F.array(*[F.lit(d) for d in detectors])).withColumn("duration", F.lit(float(duration)))
    return out.withColumn("scene_id", canonical_hash(16, split=F.col("split"), scene=F.col("id"), seed=F.lit(seed))).drop("id", "__u")


def injection_population(windows: DataFrame, per_split: dict[str, int], live_time: dict[str, float], volume: float, rate: float, seed: int, spark: SparkSession) -> DataFrame:
    """Injections assigned to the windows of their split round by round in hash order, with the weight
    rate * volume * time / n / (1 + z) and masses and redshift drawn by hash."""
    parts = [spark.range(n).select(F.lit(s).alias("split"), F.col("id").alias("i"), F.lit(float(live_time[s])).alias("time"), F.lit(n).alias("n")) for s, n in sorted(per_split.items())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    by = Window.partitionBy("split")
    ranked = windows.withColumn("__j", F.row_number().over(by.orderBy(seeded_hash(seed, F.col("window_id")), "window_id")) - 1).withColumn("__n", F.count("*").over(by)).select("split", "window_id", "__j", "__n")
    sizes = ranked.select("split", "__n").distinct()
    placed = rows.join(F.broadcast(sizes), "split").withColumn("__j", F.pmod("i", "__n")).drop("__n").join(ranked.drop("__n"), ["split", "__j"]).drop("__j")
    who = (F.col("split"), F.col("i").cast("string"))
    m1, m2 = log_uniform(draw(seed, "m1", *who), 5.0, 80.0), log_uniform(draw(seed, "m2", *who), 5.0, 80.0)
    out = placed.withColumn("mass_1", F.greatest(m1, m2)).withColumn("mass_2", F.least(m1, m2)).withColumn("redshift", draw(seed, "z", *who))
    weight = F.lit(rate) * volume * F.col("time") / F.col("n") / (1 + F.col("redshift"))
    return out.withColumn("vt_weight", weight).withColumn("injection_id", canonical_hash(16, seed=F.lit(seed), split=F.col("split"), index=F.col("i"))).drop("i", "time", "n")


def background_bank(windows: DataFrame, series: DataFrame, block: str, per_block: int, order: Sequence[str], rate: int, most: int | None = None) -> DataFrame:
    """The first `per_block` windows of each block with the samples of each of their detectors: window_id, ifo, values.

    windows (window_id, gps_start, gps_end, ifos and `block`), series (ifo, gps_start, values at `rate`). A window whose
    detector has no series that holds all of it is an error; `most` windows are taken in order, all if it isn't given.
    """
    chosen = top_k(windows, [block], order, per_block).drop("nth")
    if most is not None:
        chosen = chosen.orderBy(*order).limit(most)
    wanted = chosen.select("window_id", "gps_start", "gps_end", F.explode("ifos").alias("ifo"))
    held = series.select("ifo", F.col("gps_start").alias("__s"), "values", (F.col("gps_start") + F.size("values") / rate).alias("__e"))
    size = series.agg(F.max(F.size("values") / rate)).first()[0] or 1
    width = max(1, int(size) + 1)
    # a window lies in the series that starts in its bucket of time or in the one before
    a = wanted.withColumn("__b", F.explode(F.array(F.floor(F.col("gps_start") / width), F.floor(F.col("gps_start") / width) - 1)))
    b = held.withColumn("__b", F.floor(F.col("__s") / width))
    met = a.join(b, ["ifo", "__b"]).where((F.col("__s") <= F.col("gps_start")) & (F.col("__e") >= F.col("gps_end")))
    first = F.round((F.col("gps_start") - F.col("__s")) * rate).cast("int") + 1
    cut = F.slice("values", first, F.round((F.col("gps_end") - F.col("gps_start")) * rate).cast("int"))
    out = met.groupBy("window_id", "ifo").agg(F.min_by(cut, F.col("__s")).alias("values"))
    require(wanted.select("window_id", "ifo").join(out.select("window_id", "ifo"), ["window_id", "ifo"], "left_anti"), "a window has no series")
    return out


def overlap_scenes(backgrounds: DataFrame, signals: DataFrame, glitches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mixtures of paired rows: scene_id, ifo, mixture, clean (without the glitch). pairs (scene_id, window_id,
    injection_id, glitch_id); arrays by ifo. A detector without a signal or glitch has none of it."""
    rows = pairs.join(backgrounds.withColumnRenamed("values", "noise"), "window_id")
    rows = rows.join(signals.withColumnRenamed("values", "signal"), ["injection_id", "ifo"], "left").join(glitches.withColumnRenamed("values", "glitch"), ["glitch_id", "ifo"], "left")
    add = lambda a, b: F.when(F.col(b).isNull(), a).otherwise(F.zip_with(a, F.col(b), lambda x, y: x + y))
    clean = rows.withColumn("clean", add(F.col("noise"), "signal"))
    return clean.select("scene_id", "ifo", add(F.col("clean"), "glitch").alias("mixture"), "clean")
