"""Joins that Spark has no operator for, as equi-joins with a residual condition or as windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.contracts import duplicates, missing_references, require
from skylattice.plans.ranking import earlier_parts, ranked, with_each


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, band: float, how: str = "inner") -> DataFrame:
    """Rows with equal keys and |left_value - right_value| <= band (inclusive).

    Values are put in buckets of the band's width; the right side is repeated for the three buckets it can meet, so the
    join is an equi-join that shuffles once, not a nested loop. The right side's keys are dropped.
    """
    width = band or 1
    a = left.withColumn("__bucket", F.floor(F.col(left_value) / width).cast("bigint"))
    b = right.withColumn("__b", F.explode(F.array(*[F.floor(F.col(right_value) / width).cast("bigint") + i for i in (-1, 0, 1)])))
    for k in keys:
        b = b.withColumnRenamed(k, f"__k_{k}")
    on = (a["__bucket"] == b["__b"]) & (F.abs(a[left_value] - b[right_value]) <= band)
    for k in keys:
        on &= a[k] == b[f"__k_{k}"]
    return a.join(b, on, how).drop("__bucket", "__b", *[f"__k_{k}" for k in keys])


def without_overlap(df: DataFrame, start: str, end: str, vetoes: DataFrame, veto_start: str, veto_end: str, bucket: int, row: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose half-open interval overlaps no veto; `row` is a column that identifies rows. Both sides are spread over
    the buckets they touch, an equi-join finds which rows to drop, and an anti join drops them. Vetoes may be of any
    number. Rows without start or end, or whose end isn't behind their start, overlap nothing and stay."""
    spread = lambda d, s, e, out: d.withColumn(out, F.explode(F.sequence(F.floor(F.col(s) / bucket).cast("bigint"), F.floor(F.col(e) / bucket).cast("bigint"))))
    there = df.where(F.col(start) < F.col(end)).select(F.col(row).alias("__row"), *keys, F.col(start).alias("__s"), F.col(end).alias("__e"))
    a = spread(there, "__s", "__e", "__bucket")
    b = vetoes.where(F.col(veto_start) < F.col(veto_end)).select(*keys, F.col(veto_start).alias("__vs"), F.col(veto_end).alias("__ve"))
    b = spread(b, "__vs", "__ve", "__bucket")
    same = [a[k].eqNullSafe(b[k]) for k in ["__bucket", *keys]]
    hit = a.join(b, [*same, (a["__s"] < b["__ve"]) & (a["__e"] > b["__vs"])], "left_semi").select("__row").distinct()
    return df.join(hit, df[row] == hit["__row"], "left_anti")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, payload: Sequence[str], tie: str, part: float | None = None) -> DataFrame:
    """Each left row with the latest right row at or before it (the last by `tie` among equals), else nulls.

    One shuffle on the keys: the union of both sides is sorted by time, right rows first among equals, and the last
    right row seen is carried forward. With `part` a key is cut into parts of that length of time, which are sorted on
    their own and get the last right row of the parts before; that is for keys with very many rows.
    """
    columns = left.columns
    a = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("bigint").alias("__tie"), F.struct(*columns).alias("__left"))
    right_row = F.struct(F.col(right_time).alias("matched_time"), *payload)
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(tie).cast("bigint").alias("__tie"), right_row.alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    by, seen = list(keys), F.lit(None)
    if part is not None:
        both = both.withColumn("__part", F.coalesce(F.floor(F.col("__t") / part), F.lit(-(1 << 62))))
        latest = F.max_by("__right", F.when(F.col("__side") == 0, F.struct("__t", "__tie")))
        both = earlier_parts(both, keys, "__part", "__seen", latest, lambda c: F.last(c, ignorenulls=True))
        by, seen = [*keys, "__part"], F.col("__seen")
    upto = Window.partitionBy(*by).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("__right", ignorenulls=True).over(upto)
    carried = both.withColumn("__last", last if part is None else F.coalesce(last, seen)).where("__side = 1")
    return carried.select("__left.*", F.col("__last.matched_time").alias("matched_time"), *[F.col(f"__last.{p}").alias(p) for p in payload])


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, left_time: str, right_time: str, right_tie: str, tolerance: float) -> DataFrame:
    """Each left row with the nearest right row within the tolerance (first by `right_tie` among equals); left rows
    without one are left out."""
    near = band_join(left, right, keys, left_time, right_time, tolerance)
    best = Window.partitionBy(left_id).orderBy(F.abs(F.col(left_time) - F.col(right_time)), right_tie)
    return near.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__nth")


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Full outer 1:1 pairing: keys, both rows as structs, and whether each is there. Contracts on it are the caller's."""
    a = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias(names[0]), F.lit(True).alias(f"has_{names[0]}"))
    b = right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias(names[1]), F.lit(True).alias(f"has_{names[1]}"))
    out = a.join(b, list(keys), "full_outer")
    return out.withColumns({f"has_{n}": F.coalesce(f"has_{n}", F.lit(False)) for n in names})


def shifted_pairs(windows: DataFrame, slides: DataFrame, time_key: str, payload_a: Sequence[str], payload_b: Sequence[str]) -> DataFrame:
    """Windows of the reference joined with windows that start `offset` later; slides (slide, offset) is a table of
    parameters, and the join itself is an equi-join on the shifted key."""
    a = windows.select(F.col(time_key).alias("t_a"), *[F.col(c).alias(f"a_{c}") for c in payload_a])
    a = with_each(a, slides)
    b = windows.select(F.col(time_key).alias("t_b"), *[F.col(c).alias(f"b_{c}") for c in payload_b])
    return a.withColumn("t_b", F.col("t_a") + F.col("offset")).join(b, "t_b")


def round_robin(spark: SparkSession, rows: DataFrame, blocks: DataFrame, row_order: Sequence, block_order: Sequence) -> DataFrame:
    """Row i goes to block i mod n in the order given (use 0, 1, 2 ...), turn i div n."""
    b = ranked(spark, blocks, block_order, "__j")
    n = max(blocks.count(), 1)
    a = ranked(spark, rows, row_order, "__i")
    return a.withColumn("__j", F.pmod("__i", F.lit(n))).withColumn("turn", F.floor(F.col("__i") / n)).join(b, "__j").drop("__i", "__j")


def verified(left: DataFrame, right: DataFrame, keys: Sequence[str], equal: Sequence[str] = (), close: Sequence[str] = (), tolerance: float = 1e-12, complete: bool = False) -> DataFrame:
    """Inner join of rows to their parent, one each. A row without a parent, a parent twice, another value of an `equal`
    column (hashes, identities; nulls differ from values) or a `close` one beyond the tolerance is an error. With
    `complete` a parent without a row is one too. The columns of the right side that both have are left out."""
    require(duplicates(right, *keys), "a parent is there twice")
    require(missing_references(left, right, *keys), "a row has no parent")
    if complete:
        require(missing_references(right, left, *keys), "a parent has no row")
    marked = right.withColumnsRenamed({c: f"__r_{c}" for c in (*equal, *close)})
    out = left.join(marked, list(keys))
    differs = [~F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in equal]
    differs += [~F.coalesce(F.abs(F.col(c) - F.col(f"__r_{c}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"__r_{c}"))), F.col(c).isNull() & F.col(f"__r_{c}").isNull()) for c in close]
    if differs:
        bad = reduce(lambda a, b: a | b, differs)
        require(out.where(bad).select(*keys, *equal, *close), "a row differs from its parent")
    both = [c for c in right.columns if c in left.columns and c not in (*keys, *equal, *close)]
    if both:
        raise ValueError(f"both sides have columns {both}")
    return out.drop(*[f"__r_{c}" for c in (*equal, *close)])


def aligned(df: DataFrame, key: str, detector: str, wanted: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each key that has all wanted detectors: the values of each as <detector>_<value>. A detector that a
    key has twice is an error."""
    rows = df.where(F.col(detector).isin(*wanted))
    require(duplicates(rows, key, detector), "a key has a detector twice")
    wide = rows.groupBy(key).agg(
        F.count("*").alias("__n"), *[F.max(F.when(F.col(detector) == d, F.col(v))).alias(f"{d}_{v}") for d in wanted for v in values]
    )
    return wide.where(F.col("__n") == len(wanted)).drop("__n")


def pairs_within(candidates: DataFrame, parent: str, detector: str, first: str, second: str, limit: float) -> DataFrame:
    """Pairs of candidates of two detectors within a parent whose intervals are no further apart than the limit: parent,
    then the columns of both as a_<column> and b_<column>."""
    side = lambda d, n: candidates.where(F.col(detector) == d).select(parent, *[F.col(c).alias(f"{n}_{c}") for c in candidates.columns if c != parent])
    gap = F.greatest(F.lit(0.0), F.col("a_gps_start") - F.col("b_gps_end"), F.col("b_gps_start") - F.col("a_gps_end"))
    return side(first, "a").join(side(second, "b"), parent).where(gap <= limit)


def matched(left: DataFrame, right: DataFrame, key: str, right_key: str, ordinal: str | None = None) -> DataFrame:
    """All left rows with the columns of the right row of their key, and whether there is one (`matched`). Of right rows
    with one key the last by `ordinal` counts (its place in the catalog), without it the last by the order of columns."""
    values = [c for c in right.columns if c not in (right_key, ordinal)]
    last = F.max(F.struct(*values)) if ordinal is None else F.max_by(F.struct(*values), F.struct(ordinal, F.struct(*values)))
    one = right.groupBy(F.col(right_key).alias("__key")).agg(last.alias("__v"))
    return left.join(one, left[key] == one["__key"], "left").select(*[left[c] for c in left.columns], F.col("__key").isNotNull().alias("matched"), "__v.*")


def asof_by_detector(events: DataFrame, segments: DataFrame, detectors: Sequence[str], least: int, context: float) -> DataFrame:
    """Events (event_id, run, ifo, t) with a map detector -> segment of the segments (run, ifo, start, end, segment) that
    are the last to start before them and hold their whole context. An event needs its own detector and `least` of them."""
    wide = events.withColumn("detector", F.explode(F.array(*[F.lit(d) for d in detectors]))).withColumn("__t", F.col("t").cast("double"))
    at = segments.select("run", F.col("ifo").alias("detector"), F.col("start").cast("double").alias("start"), "end", "segment")
    found = asof_join(wide, at, ["run", "detector"], "__t", "start", ["end", "segment"], "segment")
    good = (F.col("matched_time") <= F.col("t") - context / 2) & (F.col("end") >= F.col("t") + context / 2)
    by = found.where(good).groupBy("event_id", "ifo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("detector", "segment")))).alias("segments"))
    return by.where(F.map_contains_key("segments", F.col("ifo")) & (F.size("segments") >= least))
