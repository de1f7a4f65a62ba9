"""Jaccard join of texts on their word n-grams by rare-first prefix filtering.

1. Every text becomes its set of distinct n-grams, each one 64-bit hash. Texts with equal sets are one class.
2. All texts are counted into a table of fixed size, and n-grams are ordered by it, the rare ones first. The order is the same for
   all sets; how good it is decides only how much work is left, never which links are found.
3. The prefix of a set is its n - ceil(t n) + 1 first n-grams: two sets that are similar enough share one of their
   prefixes for certain. n-grams that are in one prefix only go; the others join the sets that hold them, and a set that
   the length filter and the positional filter leave no partner there goes too.
4. n-grams that travel together (their holders' rarest shared n-gram is mostly the same one) are one bucket, so that a set
   meets its partners in few places and not once for each shared n-gram. A bucket too large for a task is cut into
   blocks, and each two blocks meet in a task; small buckets share a task.
5. In a task, a pair goes through the length filter, the join on prefix n-grams, the positional filter and the suffix
   filter before it is verified on full sets. It counts in the first bucket that both sets are in, so once.
6. A task returns how many documents each set is linked with, and links that hold its sets together, not all pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import checkpoint, release, small_batches
from skylattice.llm.components import components
from skylattice.llm.near_dedup import Shingler, digest

#: Counters of n-grams (a power of two), the slices in which they travel, and parts of a slice added in one task.
COUNTERS, SLICES, FAN = 1 << 22, 64, 32
#: Sets of a list that are looked at two by two before their sets are made, and rows up to which a table is broadcast.
SHORT, BROADCAST_ROWS = 32, 500_000
#: Sets and n-grams of a block, and classes of n-grams that the suffix filter counts.
ROWS, GRAMS, CLASSES = 512, 1 << 18, 64

SHIFT = np.uint64(64 - (COUNTERS.bit_length() - 1))


def counters(spark: SparkSession, docs: DataFrame, words: int, text_col: str = "text") -> np.ndarray:
    """How many texts hold an n-gram of each counter, over all texts; 65,535 and more are one."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, counts = Shingler(words), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(counts, s.set_of(t) >> SHIFT, 1)
        part, found = TaskContext.get().partitionId(), np.split(counts, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in found], pa.binary())], ["slice", "part", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // SLICES, np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(zlib.decompress(x), np.int64)
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "part": rows["next"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = checkpoint(spark, docs.select(docs[text_col].alias("text")).mapInArrow(run, "slice int, part long, counts binary"))
    last = parts.agg(F.max("part")).first()[0] or 0
    while last > 0:
        parts = parts.withColumn("next", F.floor(F.col("part") / FAN)).groupBy("slice", "next").applyInPandas(add, "slice int, part long, counts binary")
        last //= FAN
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in parts.collect():  # SLICES rows
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.minimum(out.ravel(), 65535).astype(np.uint16)


def rare_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order of sorted n-grams: by their counter, then by hash."""
    return np.argsort(counts[grams >> SHIFT], kind="stable")


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Of n n-grams at most n - ceil(percent n / 100) can be missing from a set that is similar enough; one more is shared."""
    return n + (-percent * n) // 100 + 1


def prefixes(spark: SparkSession, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, counts: Broadcast) -> DataFrame:
    """id, n, digest and prefix of every row."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(words)
        for batch in batches:
            sets = [s.set_of(t) for t in batch.column(1).to_pylist()]
            heads = [x[rare_first(x, counts.value)[: prefix_length(len(x), percent)]] if len(x) else x for x in sets]
            at = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))],
                ["id", "n", "digest", "prefix"],
            )

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n long, digest binary, prefix array<long>")


class Cell:
    """The sets that meet in a task: n-grams numbered rare first, each set in that order, its prefix at the head."""

    def __init__(self, sets: list[np.ndarray], weight: np.ndarray, buckets: list[np.ndarray], percent: int, counts: np.ndarray):
        self.percent, self.weight, self.buckets = percent, weight, [b.tolist() for b in buckets]
        self.n = np.array([len(x) for x in sets], np.int64)
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        number = np.empty(len(known), np.int64)
        number[rare_first(known, counts)] = np.arange(len(known))
        owner = np.repeat(np.arange(len(sets)), self.n)
        ids = number[ids]
        self.flat = ids[np.lexsort((ids, owner))]
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.k = prefix_length(self.n, percent)
        self.last = self.flat[self.at[:-1] + self.k - 1]
        classes = np.bincount(owner * CLASSES + ids % CLASSES, minlength=len(sets) * CLASSES)
        self.whole = classes.reshape(-1, CLASSES)
        head = np.arange(len(ids)) - self.at[owner] < self.k[owner]
        self.behind = self.whole - np.bincount(owner[head] * CLASSES + self.flat[head] % CLASSES, minlength=len(sets) * CLASSES).reshape(-1, CLASSES)
        self.mark = np.zeros(len(known), np.int32)
        self.links = np.zeros(len(sets), np.int64)
        self.label = np.arange(len(sets))
        self.edges: list[tuple[int, int]] = []

    def enough(self, common: np.ndarray, x: int, ys: np.ndarray) -> np.ndarray:
        return (100 + self.percent) * common >= self.percent * (self.n[x] + self.n[ys])

    def gathered(self, ys: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first `length` n-grams of sets, one after the other, and where each begins."""
        begins = np.cumsum(length) - length
        return self.flat[np.repeat(self.at[ys] - begins, length) + np.arange(int(length.sum()))], begins

    def partners(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Those of ys, all of a fitting length, that are similar enough to x."""
        own = self.flat[self.at[x] : self.at[x + 1]]
        head = own[: self.k[x]]
        self.mark[head] = 1
        grams, begins = self.gathered(ys, self.k[ys])
        shared = np.add.reduceat(self.mark[grams], begins)
        self.mark[head] = 0
        # up to the smaller of the two last numbers both sets are known; behind it they share no more than the smaller rest
        known_y = np.where(self.last[ys] <= self.last[x], self.k[ys], np.add.reduceat((grams <= self.last[x]).astype(np.int64), begins))
        known_x = np.where(self.last[x] <= self.last[ys], self.k[x], np.searchsorted(head, self.last[ys], "right"))
        good = (shared > 0) & self.enough(shared + np.minimum(self.n[x] - known_x, self.n[ys] - known_y), x, ys)
        ys, shared = ys[good], shared[good]
        if not len(ys):
            return ys
        # of each class of n-grams behind the prefix that ends first, no more are shared than the set with fewer of them has
        first = (self.last[x] <= self.last[ys])[:, None]
        rest = np.where(first, np.minimum(self.behind[x], self.whole[ys]), np.minimum(self.whole[x], self.behind[ys])).sum(axis=1)
        ys = ys[self.enough(shared + rest, x, ys)]
        if not len(ys):
            return ys
        self.mark[own] = 1
        grams, begins = self.gathered(ys, self.n[ys])
        common = np.add.reduceat(self.mark[grams], begins)
        self.mark[own] = 0
        return ys[self.enough(common, x, ys)]

    def elsewhere(self, x: int, ys: np.ndarray, bucket: int, shared: np.ndarray) -> np.ndarray:
        """Which of ys have a smaller bucket in common with x; `shared` says who has a smaller bucket at all."""
        out = np.zeros(len(ys), bool)
        if shared[x]:
            mine = {b for b in self.buckets[x] if b < bucket}
            for i in np.flatnonzero(shared[ys]).tolist():
                out[i] = not mine.isdisjoint(self.buckets[ys[i]])
        return out

    def join(self, bucket: int, left: np.ndarray, right: np.ndarray | None) -> None:
        """Count the links between two blocks of a bucket, or within one block."""
        inside = right is None
        right = left if inside else right
        right = right[np.argsort(self.n[right], kind="stable")]
        sizes = self.n[right]
        low = np.searchsorted(100 * sizes, self.percent * self.n[right if inside else left], "left")
        high = np.searchsorted(self.percent * sizes, 100 * self.n[right if inside else left], "right")
        smaller = np.zeros(len(self.n), bool)
        for i in {*left.tolist(), *right.tolist()}:
            smaller[i] = min(self.buckets[i]) < bucket
        for i, x in enumerate((right if inside else left).tolist()):
            ys = right[i + 1 if inside else low[i] : high[i]]
            if len(ys):
                ys = ys[~self.elsewhere(x, ys, bucket, smaller)]
            if len(ys):
                self.linked(x, self.partners(x, ys))

    def linked(self, x: int, ys: np.ndarray) -> None:
        if not len(ys):
            return
        self.links[x] += self.weight[ys].sum()
        self.links[ys] += self.weight[x]
        apart = ys[self.label[ys] != self.label[x]]
        while len(apart):
            self.edges.append((x, int(apart[0])))
            self.label[self.label == self.label[apart[0]]] = self.label[x]
            apart = apart[self.label[apart] != self.label[x]]


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """(v, rep, n, c) of the sets that can have a partner in a list: for lists of up to SHORT sets the length filter and
    the positional filter (what two sets share of an n-gram's list and behind it) look at each two sets. Longer lists stay whole."""
    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)"
    short = lists.where(F.col("c") <= SHORT).groupBy("v").agg(F.max("c").alias("c"), F.collect_list(F.struct("rep", "n", "pos")).alias("l"))
    short = short.select("v", "c", F.expr(f"inline(filter(l, x -> exists(l, y -> y.rep <> x.rep and {fits})))"))
    return short.select("v", "rep", "n", "c").unionByName(lists.where(F.col("c") > SHORT).select("v", "rep", "n", "c"))


def _buckets(spark: SparkSession, lists: DataFrame) -> DataFrame:
    """(bucket, rep, n): n-grams are in the bucket of the n-gram that is the rarest one for most of their holders."""
    rarest = lists.groupBy("rep").agg(F.min(F.struct("c", F.xxhash64("v").alias("h"), "v")).alias("x")).select("rep", F.col("x.v").alias("lead"))
    votes = lists.join(rarest, "rep").groupBy("v", "lead").agg(F.count("*").alias("votes"))
    bucket = checkpoint(spark, votes.groupBy("v").agg(F.max_by("lead", F.struct("votes", "lead")).alias("bucket")))
    return checkpoint(spark, lists.join(bucket, "v").select("bucket", "rep", "n").distinct())


def _cells(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rep, buckets, and the cells in which a set meets others: small buckets share one, a block of a large bucket meets each block of it."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.sum("n").alias("grams")).where("c > 1")
    sizes = checkpoint(spark, sizes.select("bucket", "grams", F.ceil(F.greatest(F.col("c") / ROWS, F.col("grams") / GRAMS)).alias("blocks")))
    tasks = int((sizes.where("blocks = 1").agg(F.sum("grams")).first()[0] or 0) / GRAMS) + 1
    placed = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64(F.lit(53), "rep"), F.col("blocks")))
    large = F.col("blocks") > 1
    cell = F.when(large, F.col("bucket")).otherwise(F.pmod(F.xxhash64(F.lit(59), "bucket"), F.lit(tasks)))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct("bucket", "block", large.alias("large"), cell.alias("cell"), F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    return placed.groupBy("rep").agg(F.collect_set("bucket").alias("buckets"), F.flatten(F.collect_list(each)).alias("cells"))


def _with_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """wanted (rep, digest, more columns) with the full set of each class; texts are read again but only these are kept."""
    few = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()
    keys = F.broadcast(wanted) if few[0] + few[1] <= BROADCAST_ROWS else wanted
    more = [c for c in wanted.columns if c not in ("rep", "digest")]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(keys.withColumnRenamed("rep", "id"), "id").select("id", "text", "digest", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(words)
        for batch in batches:
            sets = [s.set_of(t) for t in batch.column(1).to_pylist()]
            own = pa.array([digest(x) == d for x, d in zip(sets, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), *batch.columns[3:]], ["rep", "set", *more]).filter(own)

    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in more)
    return rows.mapInArrow(run, f"rep {wanted.schema['rep'].dataType.simpleString()}, set binary, {kinds}")


def _linked(members: DataFrame, percent: int, counts: Broadcast) -> DataFrame:
    """rep, links (documents of other classes that it's linked with, to add up), other (a class that it's linked with, or null)."""
    kind = members.schema["rep"].dataType.simpleString()

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        x = x.drop_duplicates(["bucket", "rep"])  # rows repeated with one id
        reps, which = np.unique(x["rep"].to_numpy(), return_index=True)
        one = x.iloc[which]
        cell = Cell([np.frombuffer(s, np.uint64) for s in one["set"]], one["weight"].to_numpy(), list(one["buckets"]), percent, counts.value)
        place = np.searchsorted(reps, x["rep"].to_numpy())
        bucket, block = x["bucket"].to_numpy(), x["block"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order])) + 1
        i, j = int(x["i"].iloc[0]), int(x["j"].iloc[0])
        for some in np.split(order, ends):
            if i == j:
                cell.join(int(bucket[some[0]]), place[some], None)
            else:
                cell.join(int(bucket[some[0]]), place[some[block[some] == i]], place[some[block[some] == j]])
        hit = np.flatnonzero(cell.links)
        a, b = (np.array([e[k] for e in cell.edges], np.int64) for k in (0, 1))
        return pd.DataFrame({"rep": np.concatenate([reps[hit], reps[a]]), "links": np.concatenate([cell.links[hit], np.zeros(len(a), np.int64)]), "other": [*[None] * len(hit), *reps[b]]})

    return members.select("rep", "set", "weight", "buckets", F.inline("cells")).groupBy("large", "cell", "i", "j").applyInPandas(compare, f"rep {kind}, links long, other {kind}")


def ngram_join(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_links (other rows that this one is linked with).

    Null, empty and blank texts have no n-gram and are linked with nothing; a text of fewer words than an n-gram has is one
    n-gram. Rows with equal sets are linked whatever their number. A null id gets a null component and no links. Rows
    are kept one for one (repeated rows of one id are linked rows); an empty table gives an empty result. If rows of one id have
    different texts, the one with the smallest digest of its set speaks for all of them. Other columns are left
    alone, whatever their names.
    """
    release(spark)
    counts = spark.sparkContext.broadcast(counters(spark, docs, words, text_col))  # COUNTERS numbers of 16 bits
    made = checkpoint(spark, prefixes(spark, docs, words, percent, id_col, text_col, counts))
    usable = made.where("n > 0 and id is not null")
    several = checkpoint(spark, usable.groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("last")).where("one <> last").drop("last"))
    if several.take(1):
        made = made.join(several, "id", "left")
        usable = made.where("n > 0 and id is not null").withColumn("mine", F.coalesce(F.col("one") == F.col("digest"), F.lit(True)))
        made = made.withColumn("digest", F.when(F.col("n") > 0, F.coalesce("one", "digest")).otherwise(F.col("digest"))).drop("one")
        usable = usable.withColumn("digest", F.coalesce("one", "digest"))
    else:
        usable = usable.withColumn("mine", F.lit(True))
    first = F.min(F.when(F.col("mine"), F.struct("id", "n", "prefix"))).alias("x")
    classes = usable.groupBy("digest").agg(first, F.count("*").alias("weight")).select("digest", "x.*", "weight").withColumnRenamed("id", "rep")
    classes = checkpoint(spark, classes)

    values = classes.select("rep", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "v"))
    sizes = values.groupBy("v").agg(F.count("*").alias("c")).where("c >= 2")
    lists = checkpoint(spark, values.join(sizes, "v"))
    release(spark)
    cells = _cells(spark, _buckets(spark, checkpoint(spark, _met(lists, percent))))
    wanted = checkpoint(spark, classes.select("rep", "digest", "weight").join(cells, "rep"))
    release(spark)
    found = checkpoint(spark, _linked(_with_sets(docs, wanted, words, id_col, text_col), percent, counts))
    release(spark)
    comp = components(spark, found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labelled = classes.select("digest", "rep", "weight").join(degree, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("digest", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    out = made.join(labelled, "digest", "left")
    real = (F.col("n") > 0) & F.col("id").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(real, F.col("component")).otherwise(F.col("id")).alias("component_id"), F.when(real, F.col("links")).otherwise(0).alias("n_links")
    )
