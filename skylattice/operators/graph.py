"""Components of shared resources, and greedy choices over their aggregates."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that spark.checkpoint.dir names. Only a local session may do without."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set; it must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def connected_components(spark: SparkSession, edges: DataFrame, left: str, right: str, most: int = 60) -> DataFrame:
    """(left, component) of a bipartite graph: rows that share a resource, directly or through others, have the smallest
    left value of them all. Rows are linked with the smallest row of each resource; large-star and small-star steps, with
    combining minima, then halve distances until the links stay the same. The lineage is cut in every step; links that
    haven't settled after `most` steps are an error."""
    edges = checkpoint(spark, edges.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l is not null and r is not null").distinct())
    hubs = edges.groupBy("r").agg(F.min("l").alias("v"))
    links = checkpoint(spark, edges.join(hubs, "r").select(F.col("l").alias("u"), "v").where("u <> v").distinct())
    low = lambda df: df.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    for _ in range(most):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(low(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(low(large), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low(large).select("u", F.col("m").alias("v")))
        new = checkpoint(spark, small.where("u <> v").distinct())
        # of two equal sets neither has a link that the other lacks
        changed = new.join(links, ["u", "v"], "left_anti").limit(1).count() or links.join(new, ["u", "v"], "left_anti").limit(1).count()
        links = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    found = links.groupBy(F.col("u").alias("l")).agg(F.min("v").alias("c"))
    return edges.select("l").distinct().join(found, "l", "left").select(F.col("l").alias(left), F.coalesce("c", "l").alias("component"))


def greedy_cover(spark: SparkSession, counts: DataFrame, want: int, most: int, order: Sequence[str] = (), batch: int = 512) -> DataFrame:
    """step, name, gain: names (files, or components of files) chosen one by one to fill labels up to `want` rows each.

    counts: name, label, n, and cost (files that a name adds; 1 if the column isn't there) and columns of `order`. The
    best gain for its cost comes first, then gain, number of labels that still lack rows, the columns of `order` (larger
    first), and the name (smaller first). `most` bounds the sum of the costs.

    Gains only fall as labels fill up, so a gain computed before is a bound on what it is now. A round takes the `batch`
    best names by present gains with the rank of the next one, and chooses among them until their best is no better than
    that one was: names beyond can't win before. The rounds, each an aggregate-free pass over one row for each name, are
    far fewer than the names chosen; `batch` rows reach the driver in each.
    """
    counts = counts if "cost" in counts.columns else counts.withColumn("cost", F.lit(1))
    entry = F.struct("label", F.col("n").cast("bigint").alias("n"))
    names = counts.where("n > 0 and label is not null").groupBy("name").agg(F.collect_list(entry).alias("rows"), *[F.first(c).alias(c) for c in ("cost", *order)])
    names = checkpoint(spark, names.where("cost > 0 and name is not null"))
    lack = {r["label"]: want for r in names.select(F.explode("rows.label").alias("label")).distinct().collect()}
    spent, out = 0, []

    def place(r, left: dict) -> tuple:
        """The smaller, the earlier the name comes."""
        gain = sum(min(x["n"], left[x["label"]]) for x in r["rows"])
        open_labels = sum(left[x["label"]] > 0 for x in r["rows"])
        return (-round(gain / r["cost"], 9), -gain, -open_labels, *[(r[c] is None, -r[c] if r[c] is not None else 0) for c in order], r["name"])

    while spent < most and any(lack.values()):
        table = F.create_map(*[F.lit(x) for k, v in lack.items() if v > 0 for x in (k, v)])
        fill = F.transform("rows", lambda x: F.least(x["n"], F.coalesce(table[x["label"]], F.lit(0))))
        now = names.where(F.col("cost") + spent <= most).withColumn("fill", fill)
        if out:
            now = now.join(F.broadcast(spark.createDataFrame([(n,) for _, n, _ in out], names.select("name").schema)), "name", "left_anti")  # at most `most` names
        now = now.withColumn("gain", F.aggregate("fill", F.lit(0).cast("bigint"), lambda x, y: x + y)).withColumn("labels", F.size(F.filter("fill", lambda x: x > 0)))
        best = now.where("gain > 0").orderBy(F.desc(F.round(F.col("gain") / F.col("cost"), 9)), F.desc("gain"), F.desc("labels"), *[F.desc(c) for c in order], "name").limit(batch + 1)
        rows = best.collect()
        if not rows:
            break
        bound = place(rows[batch], lack) if len(rows) > batch else None
        here = rows[:batch]
        while here and spent < most:
            here = [r for r in here if r["cost"] + spent <= most]
            first = min(here, key=lambda r: place(r, lack), default=None)
            if first is None or place(first, lack)[1] == 0 or (bound is not None and place(first, lack) > bound):
                break
            out.append((len(out), first["name"], -place(first, lack)[1]))
            spent += first["cost"]
            here.remove(first)
            for x in first["rows"]:
                lack[x["label"]] = max(0, lack[x["label"]] - x["n"])
    return spark.createDataFrame([(i, str(n), g) for i, n, g in out], "step int, name string, gain long")


def restart_split(spark: SparkSession, groups: DataFrame, fractions: dict[str, float], trials: int, seed: int, most: int = 200_000) -> DataFrame:
    """group_id, split: the best of many greedy splits of groups (group_id and counts). In a trial the groups, largest
    first and equal ones in an order of its own, go where the squared relative deviation of all counts is then least.
    Trials run side by side; the groups' counts (at most `most` rows) go along with them, and a trial returns its score.
    """
    names = sorted(c for c in groups.columns if c != "group_id")
    rows = groups.select("group_id", *names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups")
    ids, x = np.array([str(r["group_id"]) for r in rows]), np.array([[float(r[c]) for c in names] for r in rows]).reshape(len(rows), len(names))
    shared, splits = spark.sparkContext.broadcast((ids, x)), sorted(fractions)

    def one(trial: int) -> tuple[float, list[int]]:
        ids, x = shared.value
        goal = np.outer([fractions[s] for s in splits], x.sum(0))
        weight = 1 / np.maximum(1.0, goal)
        tie = np.array([int(hashlib.sha256(f"{seed + trial}:{i}".encode()).hexdigest()[:13], 16) for i in ids])
        have, to = np.zeros_like(goal), np.zeros(len(ids), int)
        for g in np.lexsort((tie, -x.sum(1))).tolist():
            change = (((have + x[g] - goal) * weight) ** 2 - ((have - goal) * weight) ** 2).sum(1)
            to[g] = int(np.lexsort((np.arange(len(splits)), np.round(change, 12)))[0])
            have[to[g]] += x[g]
        return float((((have - goal) * weight) ** 2).sum()), to.tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(t, one(t)[0]) for t in pdf["id"].tolist()], columns=["trial", "score"])

    if not rows:
        return spark.createDataFrame([], "group_id string, split string")
    scores = spark.range(0, trials, 1, min(trials, spark.sparkContext.defaultParallelism)).mapInPandas(run, "trial long, score double")
    best = scores.orderBy(F.round("score", 9), "trial").first()["trial"]
    return spark.createDataFrame([(i, splits[k]) for i, k in zip(ids.tolist(), one(best)[1], strict=True)], "group_id string, split string")
