"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target says how often its words are taken: the whole part of target / size is taken of every document, the
fraction is the inclusion probability of one more copy. The cube method picks those copies: it moves the vector of
probabilities along the null space of the balancing constraints (number of documents, number of words) until all but a
few are 0 or 1, so both totals of a source stay what the probabilities promise. Large documents are decided first, all
others answering for them, so that only small ones are left. Blocks of documents fly separately; what they leave undecided
(two small documents each) flies again, level by level, until a source is one block, and only that one's last few
documents are landed: all ways to take them are compared.

Draws and blocks come from a document's id, text and source. Rows that are alike in them are numbered, so that they are dealt
over blocks as others are; which of them has which number doesn't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import BLANKS, checkpoint

#: A word with the white space before it; replaced by one letter, so that counting makes no list of words.
WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Documents in a block, blocks whose leftovers fly together, and rows up to which a table of sources or of repeated
#: documents is broadcast.
BLOCK, FAN, BROADCAST_ROWS = 1000, 250, 50_000
EPS = 1e-9
#: Times the mean of the rest, from which on a document moves without the constraint on the number of documents.
MUCH = 4
#: Documents of a source that are landed.
LAND = 10


def targets(spark: SparkSession, totals: DataFrame, most: float = 3.0) -> DataFrame:
    """source, n, source_size, target: the words to take of each source.

    Sources by code point, null last, weigh 1, 2, 3 and so on again, and share all words by weight; none gets more than
    `most` times its own, and what is over goes to the others by weight, until none is above. totals: source, size, n.
    Sources may be of any number: they are ranked by ranges, and each round is one aggregate.
    """
    ranges = max(1, math.ceil(totals.count() / BROADCAST_ROWS))
    order = totals.withColumn("none", F.col("source").isNull()).repartitionByRange(ranges, "none", "source").sortWithinPartitions("none", "source")
    order = checkpoint(spark, order.withColumn("at", F.monotonically_increasing_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = order.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("k")).select("range", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    rank = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = order.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(first), "range").select("source", "n", F.col("size").alias("source_size"), (1 + rank % 3).alias("weight"))
    ranked = checkpoint(spark, ranked)
    share, count = -1.0, -1
    while True:
        full = F.lit(share) * F.col("weight") > F.lit(most) * F.col("source_size")
        r = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("count")).first()
        if r["count"] == count or not r["weight"]:
            break
        share, count = (r["all"] - most * r["full"]) / r["weight"], r["count"]
    full = F.lit(share) * F.col("weight") > F.lit(most) * F.col("source_size")
    return ranked.select("source", "n", "source_size", F.when(full, most * F.col("source_size")).otherwise(share * F.col("weight")).cast("double").alias("target"))


def _copies_numbered(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """nth: 0 for documents that no other is like, else a number of its own for each of those alike (`key`)."""
    often = checkpoint(spark, sizes.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    many = often.count()
    if not many:
        return sizes.withColumn("nth", F.lit(0).cast("long"))
    often = (F.broadcast(often) if many <= BROADCAST_ROWS else often).withColumn("again", F.lit(True))
    marked = sizes.join(often, "key", "left")
    alike = marked.where("again").withColumn("part", F.shiftright("row", 33))
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("row"))
    # a number within each task that wrote the rows, behind those of the tasks before
    counts = alike.groupBy("key", "part").agg(F.count("*").alias("k"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("key", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    alike = alike.withColumn("within", within).join(first, ["key", "part"]).withColumn("nth", F.col("first") + F.col("within") - 1)
    return marked.where("again is null").withColumn("nth", F.lit(0).cast("long")).select(*sizes.columns, "nth").unionByName(alike.select(*sizes.columns, F.col("nth").cast("long").alias("nth")))


def _direction(a: float, x: np.ndarray, p: np.ndarray) -> np.ndarray | None:
    """How documents with words x and probabilities p answer when that of one with a words grows by one; None if they can't.

    (alpha + beta * x) * p * (1 - p) keeps the number of documents and the number of words and spares those that are
    nearly decided. A document MUCH larger than the rest can't be outweighed by as many documents as it is, nor can one
    of another size than all of the rest; then beta is 0 and only the words are kept.
    """
    w = p * (1 - p)
    n, s, squares = w.sum(), (w * x).sum(), (w * x * x).sum()
    if s == 0:
        return None if a else -w / n
    spread = n * squares - s * s
    if a * n <= MUCH * s and spread > EPS * n * squares:
        beta = (s - a * n) / spread
        return w * ((-1 - beta * s) / n + beta * x)
    return -a / s * w  # where all are of one size, that keeps both


def fly(p: list[float], x: list[float], draws: list[float], land: bool) -> list[float]:
    """The flight over documents with probabilities p, words x and a uniform number each.

    The largest undecided document moves, and all other undecided ones outweigh it, up or down as far as 0 and 1 allow;
    the draw between the two keeps expectations. So the largest are decided first, while many are left to answer for
    them, and the few that stay undecided are the smallest (and a document that has nothing to outweigh it). With `land`
    they are decided too, LAND at once, so that the number of words comes as near as they allow, then that of documents.
    """
    q, size = np.array(p, float), np.array(x, float)
    left = np.argsort(-size, kind="stable")
    left = left[(q[left] > EPS) & (q[left] < 1 - EPS)]
    alone: list[int] = []
    step = 0

    def move(units: np.ndarray, u: np.ndarray) -> np.ndarray:
        nonlocal step
        with np.errstate(divide="ignore", invalid="ignore"):
            high, low = (1 - q[units]) / u, -q[units] / u
        up, down = np.where(u > 0, high, np.where(u < 0, low, np.inf)).min(), np.where(u > 0, -low, np.where(u < 0, -high, np.inf)).min()
        moved = q[units] + (up if draws[step] * (up + down) < down else -down) * u
        step += 1
        q[units] = np.where(moved < EPS, 0.0, np.where(moved > 1 - EPS, 1.0, moved))
        return units[(q[units] > 0) & (q[units] < 1)]

    while len(left) > (LAND if land else 2):
        u = _direction(size[left[0]], size[left[1:]], q[left[1:]])
        if u is None:
            alone.append(int(left[0]))
            left = left[1:]
        else:
            left = move(left, np.concatenate([[1.0], u]))
    if land:
        last = np.array([*alone, *left.tolist()], int)[-LAND:]
        ways = (np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1
        off = np.abs((ways - q[last]) @ np.stack([size[last], np.ones(len(last))], axis=1))
        q[last] = ways[np.lexsort((off[:, 1].round(6), off[:, 0].round(6)))[0]]
        for k in alone[: max(0, len(alone) + len(left) - LAND)]:
            q[k] = float(draws[k] < q[k])
    return q.tolist()


def _fly_group(land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "draw"], ascending=[False, True], kind="stable")
        return pdf.assign(p=fly(pdf["p"].tolist(), pdf["size"].astype(float).tolist(), pdf["draw"].tolist(), land))

    return run


def mix(spark: SparkSession, docs: DataFrame, most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document, and a column that is carried along.

    Null text has size 0; null sources are one source. Rows without an id and repeated rows are documents of their own;
    the draws come from hashes of id and text, so reruns agree. An empty table gives an empty result; sources without
    words have target 0. Columns of docs other than those named aren't read.
    """
    sizes = checkpoint(
        spark,
        docs.select(
            docs[id_col].alias("doc_id"),
            docs[source_col].cast("string").alias("source"),
            F.char_length(F.regexp_replace(F.rtrim(F.coalesce(docs[text_col], F.lit("")), F.lit(BLANKS)), WORD, "x")).cast("long").alias("size"),
            F.xxhash64(docs[id_col], docs[text_col], docs[source_col].cast("string")).alias("key"),
            F.monotonically_increasing_id().alias("row"),
            *([docs[carry].alias("carried")] if carry else []),
        ),
    )
    totals = checkpoint(spark, sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))  # a row for each source
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    whole = F.floor(share + EPS).cast("int")
    plan = targets(spark, totals, most).withColumns({"whole": whole, "p": F.greatest(F.lit(0.0), share - whole), "blocks": F.ceil(F.col("n") / BLOCK)})
    plan = checkpoint(spark, plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "blocks", "p"))
    summed = plan.agg(F.count("*").alias("n"), F.coalesce(F.max("blocks"), F.lit(0)).alias("blocks")).first()
    if summed["n"] <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    hashed = F.xxhash64(F.lit(17), "key", "nth")
    units = _copies_numbered(spark, sizes).join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "whole",
        F.pmod(F.xxhash64(F.lit(3), "key", "nth"), F.col("blocks")).alias("block"),
        (F.shiftrightunsigned(hashed, 11).cast("double") / float(1 << 53)).alias("draw"),
        "p",
        *(["carried"] if carry else []),
    )
    blocks = summed["blocks"]
    schema, decided = units.schema, []
    while True:
        land = blocks <= 1
        flown = units.groupBy("source", "block").applyInPandas(_fly_group(land), schema)
        if land:
            decided.append(flown)
            break
        flown = checkpoint(spark, flown)
        decided.append(flown.where(f"p < {EPS} or p > {1 - EPS}"))
        units = flown.where(f"p >= {EPS} and p <= {1 - EPS}").withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        blocks = math.ceil(blocks / FAN)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    copies = F.col("whole") + F.when(F.col("p") > 0.5, 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *([F.col("carried").alias(carry)] if carry else []))
