"""Ranks and running sums over a whole table or a large key, without one task that holds it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.operators.graph import checkpoint

#: Rows of a key that one task may hold.
WHOLE = 1_000_000


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, nulls too."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__k_{k}"]) for k in keys], F.lit(True))


def renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__k_{k}" for k in keys})


def with_each(df: DataFrame, table: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row with every row of a table of parameters (slides, shifts, exponents, bins), which goes along as an array.
    The table's size is checked; a larger one is an error, since each row is repeated for all of it."""
    n = table.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a table of parameters has more than {most} rows")
    each = table.agg(F.collect_list(F.struct(*table.columns))).scalar()
    return df.withColumn("__each", F.explode(each)).select(*df.columns, *[F.col("__each")[c].alias(c) for c in table.columns])


def ranked(spark: SparkSession, df: DataFrame, order: Sequence, name: str = "rank") -> DataFrame:
    """Rows with their rank from 0 in an order of the whole table.

    The rows are sorted into ranges and written; a number within each range and the sizes of the ranges before it give
    the rank. Only one small row for each range is in one task.
    """
    sort = {f"__o{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)}
    keyed = df.withColumns(sort)
    dealt = checkpoint(spark, keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(part.alias("__p")).agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    rank = F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("__p", part).join(first, "__p").withColumn(name, rank).drop("__p", "__at", "__first", *sort)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, name: str, count: str, whole: int = WHOLE) -> DataFrame:
    """Rows with their place in their key, from 0, and how many rows the key has. Null keys are a key.

    Where no key has more than `whole` rows, a window on the key does; else all rows are ranked by ranges in the order of
    keys, and the first rank of each key, one row for each, is taken off, so a key of any size is spread over tasks.
    """
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= whole:
        by = Window.partitionBy(*keys)
        return df.withColumn(name, F.row_number().over(by.orderBy(*order)) - 1).withColumn(count, F.count("*").over(by))
    rows = ranked(df.sparkSession, df, [*keys, *order], name)
    each = renamed(rows.groupBy(*keys).agg(F.min(name).alias("__first"), F.count("*").alias(count)), keys)
    return rows.join(each, same_keys(rows, each, keys)).select(*df.columns, (F.col(name) - F.col("__first")).alias(name), count)


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, str], descending: bool = False, parts: int | None = None, whole: int = WHOLE) -> DataFrame:
    """Rows with the sums of columns over all rows of their key up to them in the order: new name -> column. The order
    is unique within a key.

    The rows are written once. Where no key has more than `whole` of them, a window on the key does; else (or with
    `parts`) the rows are sorted into ranges over all keys, `parts` of them if it is given, and written so, a window within a range and the sums of the ranges before it make
    the running sum, and a key of any size is spread over tasks.
    """
    spark = df.sparkSession
    sort = F.desc if descending else F.asc
    df = checkpoint(spark, df)
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= whole and parts is None:
        upto = Window.partitionBy(*keys).orderBy(sort(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    by = [*[F.col(k) for k in keys], sort(order)]
    dealt = checkpoint(spark, df.repartitionByRange(*([] if parts is None else [parts]), *by).withColumn("__part", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "__part").orderBy(sort(order)).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()})
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    totals = renamed(totals.select(*keys, F.col("__part").alias("__part_of"), *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__s_{n}") for n in sums]), keys)
    out = within.join(totals, same_keys(within, totals, keys) & (F.col("__part") == F.col("__part_of")))
    return out.select(*df.columns, *[(F.col(n) + F.col(f"__s_{n}")).alias(n) for n in sums])


def earlier_parts(df: DataFrame, keys: Sequence[str], part: str, name: str, value: Column, pick: Callable[[str], Column]) -> DataFrame:
    """Rows with what the parts of their key before theirs hold: `value` is an aggregate over a part, `pick` the window
    function that makes one value of those of the parts before (null if there are none). Only a row for each part is
    ordered by key, so a key may be of any size."""
    each = df.groupBy(*keys, part).agg(value.alias("__v"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    each = renamed(each.select(*keys, F.col(part).alias("__part_of"), pick("__v").over(before).alias(name)), keys)
    return df.join(each, same_keys(df, each, keys) & (F.col(part) == F.col("__part_of"))).select(*df.columns, name)
