"""Audits of manifests: groups, duplicates, overlaps of sources, histograms, streamed moments, verified eviction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.contracts import ContractError, require, set_difference
from skylattice.functions.columns import composition


def group_audit(df: DataFrame) -> dict[str, DataFrame]:
    """Groups of images (group_id, split, class_0, class_1): `sizes` (how many groups have how many images), `splits`
    (images, groups, instances) and `compositions` (groups by split and composition). A group lies in one split."""
    groups = df.groupBy("group_id").agg(F.count_distinct("split").alias("n"), F.min("split").alias("split"), F.count("*").alias("images"), F.sum("class_0").alias("class_0"), F.sum("class_1").alias("class_1"))
    require(groups.where("n > 1").select("group_id"), "a group is in two splits")
    return {
        "sizes": groups.groupBy("images").agg(F.count("*").alias("groups")),
        "splits": groups.groupBy("split").agg(F.sum("images").alias("images"), F.count("*").alias("groups"), F.sum("class_0").alias("class_0"), F.sum("class_1").alias("class_1")),
        "compositions": groups.groupBy("split", composition(F.col("class_0"), F.col("class_1")).alias("composition")).agg(F.count("*").alias("groups")),
    }


def sample_audit(df: DataFrame, digest: str, group: str, numbers: Sequence[str]) -> DataFrame:
    """One row: samples, groups, rows whose content another has too, sums of numbers."""
    return df.agg(F.count("*").alias("samples"), F.count_distinct(group).alias("groups"), (F.count(digest) - F.count_distinct(digest)).alias("exact_duplicates"), *[F.sum(c).alias(c) for c in numbers])


def source_overlaps(df: DataFrame, source: str, group: str) -> DataFrame:
    """Pairs of sources that share groups: left, right, shared. Sources of a group are few; they are paired, not rows."""
    sets = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.sort_array(F.collect_set(source)).alias("s")).where(F.size("s") > 1)
    left = sets.select(F.posexplode("s").alias("i", "left"), "s")
    pairs = left.select("left", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("right"))
    return pairs.groupBy("left", "right").agg(F.count("*").alias("shared"))


def field_histograms(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, value, n: how often each value of each field occurs, nulls too."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, n: different values of each field. A value is counted once, then values, so no row is kept for another field."""
    return field_histograms(df, fields).where("value is not null").groupBy("field").agg(F.count("*").alias("n"))


def moments(df: DataFrame, keys: Sequence[str], value: str, mask: str | None = None, bits: int = 0) -> DataFrame:
    """Count, sum, sum of squares, least and largest of the numbers, share of NaN, and of a mask the bits that all rows
    have, that any row has, and how many rows have each of the first `bits`."""
    x = F.col(value).cast("double")
    number = F.when(~F.isnan(x), x)
    out = [F.count(x).alias("n"), F.sum(number).alias("total"), F.sum(number * number).alias("squares"), F.min(number).alias("least"), F.max(number).alias("largest"), (F.count_if(F.isnan(x)) / F.count(x)).alias("nan_share")]
    if mask:
        m = F.col(mask).cast("bigint")
        out += [F.bit_and(m).alias("all_bits"), F.bit_or(m).alias("any_bits"), F.array(*[F.count_if(m.bitwiseAND(F.lit(1 << b)) != 0) for b in range(bits)]).alias("bit_counts")]
    return df.groupBy(*keys).agg(*out)


def evictable(required: DataFrame, scored: DataFrame, sources: DataFrame, cached: DataFrame, path: str) -> DataFrame:
    """Cached files that may go: those of sources all of whose rows are scored. The scored ids must be the required ones
    and the sources of both the same, else nothing may go and that is an error."""
    require(set_difference(required.select("row_id"), scored.select("row_id")), "scored and required rows differ")
    require(set_difference(sources.select(path).distinct(), cached.select(path).distinct()), "cached and recorded sources differ")
    return cached.join(sources.select(path).distinct(), path, "left_semi")


def eviction_intent(required: DataFrame, scored: DataFrame, sources: DataFrame, cached: DataFrame, path: str, intent: str) -> DataFrame:
    """The files of `evictable`, after they are written as JSON lines to `intent`, before anything may be deleted.

    An intent that is already there must list the same files: a job that starts again after a crash goes on with what it
    meant to delete, and one that means something else is an error. Deleting is the caller's work.
    """
    files = evictable(required, scored, sources, cached, path)
    spark = files.sparkSession
    if files.limit(1).count() == 0:
        return files
    name = spark._jvm.org.apache.hadoop.fs.Path(intent)
    fs = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(intent, "_SUCCESS")):
        require(set_difference(files.select(path), spark.read.schema(files.select(path).schema).json(intent)), "an intent of other files is there")
    else:
        files.write.mode("overwrite").json(intent)  # what a crash left half written isn't an intent
    return files


def recovery(expected: DataFrame, accepted: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """The expected rows that were rejected; accepted and rejected rows together must be the expected ones, once each."""
    both = accepted.select(key).unionByName(rejected.select(key))
    require(both.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "a row is decided twice")
    require(set_difference(expected.select(key), both), "decided and expected rows differ")
    return expected.join(rejected.select(key), key, "left_semi")


def nested_overlap(left: DataFrame, right: DataFrame, fields: Sequence[str], urls: Column | None = None) -> DataFrame:
    """field, value: what two manifests share of plain fields and of a set of urls in each row."""

    def values(df: DataFrame) -> DataFrame:
        parts = [df.select(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
        if urls is not None:
            parts.append(df.select(F.lit("url").alias("field"), F.explode(urls).alias("value")))
        return reduce(DataFrame.unionByName, parts).where("value is not null").distinct()

    return values(left).intersect(values(right))


def comparable_overlap(locked: DataFrame, other: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, value shared by a locked corpus and another manifest; nulls don't count. There must be a field that both
    have values of, else nothing is compared."""
    there = [f for f in fields if f in locked.columns and f in other.columns]
    both = [f for f in there if locked.where(F.col(f).isNotNull()).take(1) and other.where(F.col(f).isNotNull()).take(1)]
    if not both:
        raise ValueError("the manifests have no field to compare")
    return nested_overlap(locked, other, both)


def manifest_overlaps(manifests: dict[str, DataFrame], fields: Sequence[str]) -> DataFrame:
    """field, left, right, shared: how many values of each field every two manifests share, and how many different values
    one has (left = right). Nulls don't count, and a field that a manifest doesn't have is none of its.

    A value gets one bit for each manifest that holds it, in one aggregate that combines before its shuffle, however
    many manifests there are; all pairs are read off the few sets of bits that occur.
    """
    if len(manifests) > 63:
        raise ValueError("more than 63 manifests")
    parts = [df.select(F.lit(1 << i).cast("bigint").alias("bit"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for i, df in enumerate(manifests.values()) for f in fields if f in df.columns]
    if not parts:
        raise ValueError("no manifest has one of the fields")
    sets = reduce(DataFrame.unionByName, parts).where("value is not null").groupBy("field", "value").agg(F.bit_or("bit").alias("bits")).groupBy("field", "bits").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(n) for n in manifests])
    held = F.filter(F.sequence(F.lit(0), F.lit(len(manifests) - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    pairs = sets.withColumn("i", F.explode(held)).withColumn("j", F.explode(F.filter(held, lambda j: j >= F.col("i"))))
    return pairs.groupBy("field", "i", "j").agg(F.sum("n").alias("shared")).select("field", F.element_at(names, F.col("i") + 1).alias("left"), F.element_at(names, F.col("j") + 1).alias("right"), "shared")


def require_disjoint(manifests: dict[str, DataFrame], locked: str, fields: Sequence[str]) -> DataFrame:
    """The overlaps of a locked manifest with each of the others, all of them none. Sharing a value is an error, and so is
    another manifest without any field that both have values of, since nothing would be compared."""
    found = manifest_overlaps(manifests, fields).cache()
    try:
        shared = found.where((F.col("left") != F.col("right")) & ((F.col("left") == locked) | (F.col("right") == locked)))
        require(shared.where("shared > 0"), "a locked manifest shares values with another one")
        own = found.where(F.col("left") == F.col("right")).select("field", F.col("left").alias("name"))
        mine = own.where(F.col("name") == locked).select("field")
        compared = own.where(F.col("name") != locked).join(mine, "field")
        there = {r["name"] for r in compared.select("name").distinct().collect()}  # a name for each manifest
        missing = sorted(set(manifests) - {locked} - there)
        if missing:
            raise ContractError(f"nothing to compare in {missing}")
        return compared.select("field", F.col("name").alias("other"), F.lit(0).cast("bigint").alias("shared"))
    finally:
        found.unpersist()
