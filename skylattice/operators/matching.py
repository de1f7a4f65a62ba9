"""Choices that go through a table in order, each bound by all before it: one-use matching and balanced splits.

What is chosen in such an order can't be split over tasks, but what has to be remembered is small: how many rows of each
class are used, or what each split holds. So ranges of the order go one after the other, each in one task of bounded
size, and are written; only counts by class, or sums by split and label, pass from one to the next. A range rereads the
ranked tables, so `each` is to be as large as a task can hold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.contracts import duplicates, require
from skylattice.operators.graph import checkpoint
from skylattice.plans.ranking import ranked


def _few(df: DataFrame, most: int, what: str) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def one_use_match(spark: SparkSession, left: DataFrame, right: DataFrame, left_order: Column, right_order: Column, each: int = 1 << 16, classes: int = 1024) -> DataFrame:
    """(name, match): in order, each left row (name, need) takes the first unused right row (name, has) with all it needs.

    `need` and `has` are arrays (null: empty), such as of detectors; names are unique. Right rows with the same set are a
    class (at most `classes` of them), and each class is used up in order. So a range of `each` left rows needs no more
    than the next `each` rows of each class, and only the number of rows used by class is kept between ranges. Left rows
    for which nothing is left have no row.
    """
    require(duplicates(left, "name"), "a left name is there twice")
    require(duplicates(right, "name"), "a right name is there twice")
    label = lambda c: F.to_json(F.sort_array(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")).cast("array<string>"))))
    own = ranked(spark, left.select("name", label("need").alias("need"), left_order.alias("o")), ["o", "name"], "at").select("name", "need", "at")
    free = ranked(spark, right.select(F.col("name").alias("match"), label("has").alias("has"), right_order.alias("o")), ["o", "match"], "order")
    free = ranked(spark, free, ["has", "order"], "nth").select("match", "has", "order", "nth")
    own, free = checkpoint(spark, own), checkpoint(spark, free)
    sizes = _few(free.groupBy("has").agg(F.min("nth").alias("first"), F.count("*").alias("n")), classes, "classes")
    used = {r["has"]: 0 for r in sizes}
    end = {r["has"]: r["first"] + r["n"] for r in sizes}
    first = {r["has"]: r["first"] for r in sizes}
    sets = {c: frozenset(json.loads(c)) for c in used}

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        queues = {c: q.sort_values("order") for c, q in b.groupby("has")}
        order = {c: q["order"].tolist() for c, q in queues.items()}
        names = {c: q["match"].tolist() for c, q in queues.items()}
        at, fit, out = dict.fromkeys(queues, 0), {}, []
        a = a.sort_values("at")
        for name, need in zip(a["name"].tolist(), a["need"].tolist(), strict=True):
            if need not in fit:
                wanted = frozenset(json.loads(need))
                fit[need] = [c for c in queues if wanted <= sets[c]]
            heads = [(order[c][at[c]], c) for c in fit[need] if at[c] < len(order[c])]
            if heads:
                c = min(heads)[1]
                out.append((name, names[c][at[c]], c))
                at[c] += 1
        return pd.DataFrame(out, columns=["name", "match", "has"])

    schema = f"name {left.schema['name'].dataType.simpleString()}, match {right.schema['name'].dataType.simpleString()}, has string"
    done = []
    for low in range(0, own.count(), each):
        ahead = [(F.col("has") == c) & (F.col("nth") >= first[c] + used[c]) & (F.col("nth") < first[c] + used[c] + each) for c in used if first[c] + used[c] < end[c]]
        if not ahead:
            break
        a = own.where((F.col("at") >= low) & (F.col("at") < low + each)).groupBy(F.lit(0).alias("k"))
        b = free.where(reduce(lambda x, y: x | y, ahead)).groupBy(F.lit(0).alias("k"))
        done.append(checkpoint(spark, a.cogroup(b).applyInPandas(match, schema)))
        for r in done[-1].groupBy("has").agg(F.count("*").alias("n")).collect():
            used[r["has"]] += r["n"]
    return reduce(DataFrame.unionByName, done).drop("has") if done else spark.createDataFrame([], schema).drop("has")


def balanced_split(spark: SparkSession, counts: DataFrame, fractions: Mapping[str, float], each: int = 1 << 16, labels: int = 1024) -> DataFrame:
    """(name, split): each group, largest first, goes where the label counts then deviate least from their goals (sum of
    squares relative to the goal; equal ones to the first split by name).

    counts: name, label, n (at most `labels` labels; rows of a name and label are added up, null is none). Groups of one
    size go by name. A range of `each` groups is a task; between ranges, the sums by split and label are kept.
    """
    counts = counts.where("name is not null and label is not null").groupBy("name", "label").agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n"))
    total = {r["label"]: r["n"] for r in _few(counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label"), labels, "labels")}
    splits = sorted(fractions)
    schema = f"name {counts.schema['name'].dataType.simpleString()}, split string, n array<bigint>"
    if not total:
        return spark.createDataFrame([], schema).drop("n")
    vector = F.array(*[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)) for k in total])
    groups = counts.groupBy("name").agg(F.sum("n").alias("size"), vector.alias("n"))
    groups = checkpoint(spark, ranked(spark, groups, [-F.col("size"), "name"], "at").select("name", "n", "at"))
    goal = np.outer([fractions[s] for s in splits], [float(v) for v in total.values()])
    have, done = np.zeros(goal.shape), []

    def placed(have: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, weight = have.copy(), 1 / np.maximum(1.0, goal)
            for pdf in batches:
                to = []
                for x in pdf["n"].tolist():
                    change = (((held + x - goal) * weight) ** 2 - ((held - goal) * weight) ** 2).sum(1)
                    to.append(int(np.argmin(np.round(change, 12))))
                    held[to[-1]] += x
                yield pd.DataFrame({"name": pdf["name"], "split": [splits[i] for i in to], "n": pdf["n"]})

        return run

    for low in range(0, groups.count(), each):
        part = groups.where((F.col("at") >= low) & (F.col("at") < low + each)).coalesce(1).sortWithinPartitions("at").select("name", "n")
        done.append(checkpoint(spark, part.mapInPandas(placed(have), schema)))
        sums = done[-1].groupBy("split").agg(*[F.sum(F.col("n")[i]).alias(f"l{i}") for i in range(len(total))])
        for r in sums.collect():
            have[splits.index(r["split"])] += [r[f"l{i}"] for i in range(len(total))]
    return reduce(DataFrame.unionByName, done).drop("n")
