"""Contracts as DataFrames of violations, and `require`, which refuses to go on when there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a rule that an operator needs."""


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(df: DataFrame, parents: DataFrame, *keys: str) -> DataFrame:
    """Keys without a parent row; null keys count as missing."""
    return df.select(*keys).distinct().join(parents.select(*keys).distinct(), list(keys), "left_anti")


def broken_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, as a block that is in two splits."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(value)).alias("n")).where("n > 1")


def failing(df: DataFrame, **checks: Column) -> DataFrame:
    """Rows that fail a check, with the names of those they fail; a null result fails."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, c in checks.items()]))
    return df.withColumn("failed", names).where(F.size("failed") > 0)


def finite(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in columns])


def shared_values(left: DataFrame, right: DataFrame, *fields: str) -> DataFrame:
    """Values of each field that both tables hold (nulls don't count): (field, value)."""
    parts = [left.select(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")).where("value is not null").intersect(right.select(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))) for f in fields]
    return reduce(DataFrame.unionByName, parts)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, marked by side."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def uncontrolled(df: DataFrame, *fields: str) -> DataFrame:
    """Fields that should have one value and have another number of them."""
    counts = df.agg(*[F.count_distinct(F.struct(f)).alias(f) for f in fields])
    return counts.select(F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "n")).where("n <> 1")


def require(violations: DataFrame, message: str) -> None:
    """Raise if there is a violation; one row is fetched, for the message."""
    first = violations.take(1)
    if first:
        raise ContractError(f"{message}: {first[0].asDict()}")
