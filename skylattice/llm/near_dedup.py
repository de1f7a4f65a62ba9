"""Near-duplicates by bottom-k sketches, inverted lists, a filter on union sketches, and exact verification.

1. Every text becomes its set of distinct word shingles, each one 64-bit hash. Texts with equal sets are one class, which
   the smallest id stands for; from here on there are only classes.
2. The sketch of a set is its k smallest values, by one hash function for all sets; values that came back in a sample of
   the texts count as larger than all others (the more often, the larger). k isn't fixed: it is n - ceil(t n) + 1 for n
   values and threshold t, the least with which two sets that are similar enough share a value of their sketches for
   certain. So nothing rests on chance: order and sample only decide how long lists are.
3. Inverted lists of sketch values generate overlaps. A list with at most SHORT classes is expanded into pairs.
4. Two sketches are a sketch of the union, up to the smaller of their last values. What is shared of it, and what both
   sets may share behind it, bounds the similarity from above; pairs that can't reach the threshold go.
5. The exact Jaccard similarity on the full sets verifies links: first the most promising partners of each class and of
   a few pivots of each longer list, then all pairs that still lie in different components.
6. What longer lists then still hold in more than one component is compared block by block on full sets, every class
   outside a list's largest component with everything in the list; a block reports one link for each class and component.

Lists, pairs and comparisons can be many times the input, more so the larger it is. Those steps run in rounds by hash: each
round writes what it found, and its shuffle files go before the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.llm.common import checkpoint, release, small_batches
from skylattice.llm.components import components

#: Classes in a list that is expanded.
SHORT = 32
#: One text in SAMPLE is read for values that come back; at SEEN texts a value is frequent, FREQUENT of them are kept.
SAMPLE, SEEN, FREQUENT = 8, 3, 1_000_000
#: Rows of a round: values that are put into lists, list rows that meet, pairs joined with their sketches and with their
#: sets, sets in blocks of long lists; rounds that a step has at most, by one key.
VALUES, MEETING, SKETCHED, CONFIRMED, BLOCKED, ROUNDS = 12_000_000, 4_000_000, 250_000, 100_000, 150_000, 8
#: Long lists whose pivots a class is compared with, rows of the two sides of a block and values compared at once, ids up to which
#: a filter is broadcast.
LONG, ASKERS, ROWS, COLUMNS, BROADCAST_IDS = 6, 256, 512, 4096, 1_000_000
#: Pivots of a long list from the middle of its group (one more is drawn by hash), and partners confirmed first.
MIDDLE, PARTNERS = 3, 3
#: Pairs of one class that are joined with its set in one task.
SLICE = 128
#: Distinct words whose hashes a worker keeps.
WORDS_KEPT = 200_000

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    def __init__(self, words: int):
        self.words, self.known = words, {}

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles; A-Z lower-cased, words parted by ASCII white space."""
        found = (text or "").encode("utf-8", "replace").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        w = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * M1
            h ^= h >> np.uint64(29)
        h = (h * M2) ^ (h >> np.uint64(32))
        return np.unique(h)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketch_of(s: np.ndarray, percent: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The k = n - ceil(percent * n / 100) + 1 smallest values of a set, by hash with frequent values behind."""
    k = min(len(s), len(s) - -(-percent * len(s) // 100) + 1)
    if not len(frequent):
        return s[:k]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    hit = frequent[at] == s
    rare = s[~hit][:k]
    return np.concatenate([rare, s[hit][np.argsort(rank[at[hit]])][: k - len(rare)]])


def places(sketch: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The global order of a sketch's values: 0 and the hash of rare ones, 1 and the rank of frequent ones."""
    if not len(frequent):
        return np.zeros(len(sketch), np.int64), sketch
    at = np.minimum(np.searchsorted(frequent, sketch), len(frequent) - 1)
    hit = frequent[at] == sketch
    return hit.astype(np.int64), np.where(hit, rank[at].astype(np.uint64), sketch)


def most_shared(x: np.ndarray, n: int, y: np.ndarray, m: int, frequent: np.ndarray, rank: np.ndarray) -> tuple[int, int]:
    """Values that two sketches (of sets of n and m values) share, and what the sets share at most.

    Up to the smaller of the two last values both sets are known, and so is their union; behind it the sets share no
    more than what the smaller rest holds. A sketch that is its whole set has no rest.
    """
    shared = len(np.intersect1d(x, y, assume_unique=True))
    (kx, vx), (ky, vy) = places(x, frequent, rank), places(y, frequent, rank)
    last_x, last_y = (int(kx[-1]), int(vx[-1])), (int(ky[-1]), int(vy[-1]))
    known_x, known_y = len(x), len(y)
    if last_x < last_y:
        known_y = int(((ky < last_x[0]) | (ky == last_x[0]) & (vy <= np.uint64(last_x[1]))).sum())
    elif last_y < last_x:
        known_x = int(((kx < last_y[0]) | (kx == last_y[0]) & (vx <= np.uint64(last_y[1]))).sum())
    return shared, shared + min(n - known_x, m - known_y)


def common_values(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each pair of sets shares, from products of 0/1 matrices over COLUMNS values of both sides."""
    values = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(values):
        return out

    def hits(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        hit = values[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return owner[hit][order], at[hit][order]

    def marks(side: tuple[np.ndarray, np.ndarray], rows: int, first: int) -> np.ndarray:
        owner, at = side
        a, b = np.searchsorted(at, [first, first + COLUMNS])
        m = np.zeros((rows, min(COLUMNS, len(values) - first)), np.float32)
        m[owner[a:b], at[a:b] - first] = 1
        return m

    x, y = hits(left), hits(right)
    for first in range(0, len(values), COLUMNS):
        out += marks(x, len(left), first) @ marks(y, len(right), first).T
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def frequent_values(spark: SparkSession, docs: DataFrame, words: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Values that come back in a sample of the texts, sorted, and the place of each among them, the rarest first."""
    small_batches(spark)
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.setdefault("s", Shingler(words))
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(s.set_of(t).view(np.int64))], ["v"])

    some = docs.where(F.pmod(F.xxhash64(F.lit(29), docs[id_col]), SAMPLE) == 0).select(docs[text_col].alias("text"))
    counts = some.mapInArrow(run, "v long").groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") >= SEEN)
    found = counts.orderBy(F.desc("c"), "v").limit(FREQUENT).select("v").toArrow()["v"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - 1 - order).astype(np.int64)


def sketches(spark: SparkSession, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, shared: Broadcast) -> DataFrame:
    """id, n, digest, sketch of every row."""
    small_batches(spark)
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.setdefault("s", Shingler(words))
        for batch in batches:
            sets = [s.set_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) for x in sets], pa.binary()), pa.array([sketch_of(x, percent, *shared.value).view(np.int64) for x in sets], pa.list_(pa.int64()))],
                ["id", "n", "digest", "sketch"],
            )

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, n long, digest binary, sketch array<long>")


def _rounds(rows: int, most: int) -> int:
    """How many rounds of about `most` rows there are, ROUNDS at most."""
    return max(1, min(ROUNDS, ceil(rows / most)))


def _in_round(columns: list[str], rounds: int, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(53), *columns), F.lit(rounds)) == i


def _one_by_one(spark: SparkSession, parts: Iterable[DataFrame], several: bool) -> DataFrame:
    """All parts together; each is written, and its shuffle files go, before the next one runs (if there are several)."""
    written = []
    for part in parts:
        written.append(checkpoint(spark, part))
        del part
        release(spark, several)
    return reduce(DataFrame.unionByName, written)


def _cells(spark: SparkSession, pairs: DataFrame, most: int, join: Callable[[tuple[int, int, int]], DataFrame]) -> DataFrame:
    """What `join` makes of the pairs, in rounds by the hashes of both ends, so that a round has its part of either side."""
    sides = min(ROUNDS, ceil(sqrt(ceil(pairs.count() / most)))) or 1
    return _one_by_one(spark, (join((sides, i, j)) for i in range(sides) for j in range(sides)), sides > 1)


def _lists(spark: SparkSession, classes: DataFrame, rounds: int) -> DataFrame:
    """(rep, n, v) with the length c of each list, lists of one left out."""
    values = classes.select("rep", "n", F.explode("sketch").alias("v"))

    def part(i: int) -> DataFrame:
        some = values.where(_in_round(["v"], rounds, i))
        return some.join(some.groupBy("v").agg(F.count("*").alias("c")).where("c >= 2"), "v")

    return _one_by_one(spark, map(part, range(rounds)), rounds > 1)


def _pairs_of(short: DataFrame, percent: int, rounds: int, i: int) -> DataFrame:
    """Pairs of the classes in short lists that can reach the similarity, with the number of values they share there, and
    whether both have values in long lists too; those of one round, by the smaller id."""
    a, b = (short.select("v", *[F.col(c).alias(e if c == "rep" else f"{c}{e}") for c in ("rep", "n", "k")]) for e in ("a", "b"))
    a = a.where(_in_round(["a"], rounds, i))
    met = a.join(b, "v").where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    met = met.groupBy("a", "b").agg(F.count("*").alias("shared"), *[F.max(c).alias(c) for c in ("na", "nb", "ka", "kb")])
    # what both sets share of the sketch that ends first is in lists, and the rest of that set lies behind its sketch
    behind = [F.expr(f"least({n}, ({percent} * {n} + 99) div 100 - 1)") for n in ("na", "nb")]
    most = F.col("shared") + F.least("ka", "kb") + F.greatest(*behind)
    return met.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "shared", (F.least("ka", "kb") > 0).alias("long"))


def _hot(pairs: DataFrame) -> DataFrame:
    """Classes that are in more than SLICE pairs on one side, and in how many slices they are joined."""
    ends = pairs.groupBy(F.col("a").alias("end")).agg(F.count("*").alias("c")).unionByName(pairs.groupBy(F.col("b").alias("end")).agg(F.count("*").alias("c")))
    return ends.groupBy("end").agg(F.max("c").alias("c")).where(F.col("c") > SLICE).select("end", F.ceil(F.col("c") / SLICE).cast("int").alias("slices"))


def _with(pairs: DataFrame, table: DataFrame, key: str, columns: list[str], hot: DataFrame, cell: tuple[int, int, int]) -> DataFrame:
    """The pairs of one cell with columns of each end, as <column>_a and <column>_b. Classes in many pairs, as pivots are,
    come in slices that their partners are dealt over."""
    sides, *at = cell
    pairs = pairs.where(_in_round(["a"], sides, at[0]) & _in_round(["b"], sides, at[1]))
    sliced = table.withColumnRenamed(key, "end").join(hot, "end", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    for (end, other), i in zip((("a", "b"), ("b", "a")), at, strict=True):
        side = pairs.join(hot.withColumnRenamed("end", end), end, "left")
        side = side.withColumn("slice", F.pmod(F.xxhash64(F.lit(47), F.col(other)), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
        pairs = side.join(sliced.where(_in_round(["end"], sides, i)).select(F.col("end").alias(end), "slice", *[F.col(c).alias(f"{c}_{end}") for c in columns]), [end, "slice"]).drop("slice")
    return pairs


def _bounded(spark: SparkSession, pairs: DataFrame, classes: DataFrame, percent: int, hot: DataFrame, frequent: Broadcast, cell: tuple[int, int, int]) -> DataFrame:
    """Pairs of one cell whose union sketch allows a similarity that is high enough."""
    both = _with(pairs.select("a", "b"), classes, "rep", ["n", "sketch"], hot, cell).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, good = [], []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                some, most = most_shared(x.values.to_numpy().view(np.uint64), n, y.values.to_numpy().view(np.uint64), m, *frequent.value)
                shared.append(some)
                good.append(100 * min(n, m) >= percent * max(n, m) and (100 + percent) * most >= percent * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], ["a", "b", "shared"]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}, shared long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame, cell: tuple[int, int, int]) -> DataFrame:
    """Pairs of one cell whose full sets are similar enough."""
    both = _with(pairs.select("a", "b"), sets, "id", ["set"], hot, cell).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _full_sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """Full sets of the classes in `wanted` (rep, digest); texts are read again but only these are kept. Only where ids are
    repeated must their rows meet."""
    keys = _small(wanted)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(keys.withColumnRenamed("rep", "id"), "id").select("id", "text", "digest")
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.setdefault("s", Shingler(words))
        for batch in batches:
            sets = [s.set_of(t) for t in batch.column(1).to_pylist()]
            own = pa.array([digest(x) == d for x, d in zip(sets, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "set"]).filter(own)

    kind = wanted.schema["rep"].dataType.simpleString()
    sets = rows.mapInArrow(run, f"id {kind}, set binary")
    return sets.dropDuplicates(["id"]) if repeated else sets


def _label(rows: DataFrame, comp: DataFrame, key: str, name: str) -> DataFrame:
    return rows.join(comp.select(F.col("node").alias(key), F.col("component").alias("__c")), key, "left").withColumn(name, F.coalesce("__c", key)).drop("__c")


def _across_long_lists(spark: SparkSession, long_lists: DataFrame, comp: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links that long lists still hold between components: lists with the same largest component are one bucket, and
    every class of a bucket outside that component is compared with all of the bucket, on full sets."""
    rows = _label(long_lists.select("v", "rep"), comp, "rep", "comp")
    sizes = rows.groupBy("v", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("v").agg(F.max_by("comp", F.struct("k", "comp")).alias("bucket"))
    rows = checkpoint(spark, rows.join(main, "v").select("bucket", "rep", "comp").distinct())
    asks = F.col("comp") != F.col("bucket")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(asks.cast("int")).alias("asking")).where("asking > 0")
    rows = checkpoint(spark, rows.join(counts, "bucket"))
    ab, db = F.ceil(F.col("asking") / ASKERS).cast("int"), F.ceil(F.col("c") / ROWS).cast("int")
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("rep")), n).cast("int")
    rounds = _rounds(rows.agg(F.sum(ab + F.when(asks, db).otherwise(0))).first()[0] or 0, BLOCKED)

    def compare(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asking) and len(there):
            left, right = ([np.frombuffer(x, np.uint64) for x in side] for side in (asking["q_set"], there["set"]))
            both = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
            common = common_values(left, right).astype(np.int64)
            comps, ids = there["comp"].to_numpy(), there["rep"].to_numpy()
            good = 100 * common >= percent * (both - common)
            for i, (rep, c) in enumerate(zip(asking["q_rep"], asking["q_comp"], strict=True)):
                met = {c}
                for j in np.flatnonzero(good[i]).tolist():
                    if comps[j] not in met:
                        met.add(comps[j])
                        out.append((rep, ids[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    kind = long_lists.schema["rep"].dataType.simpleString()

    def part(i: int) -> DataFrame:
        """Blocks of the bucket's askers by their number, so that a large bucket is in several rounds."""
        here = rows.withColumn("abs", F.filter(F.sequence(F.lit(0), ab - 1), lambda x: F.pmod(F.xxhash64(F.lit(53), "bucket", x), F.lit(rounds)) == i)).where(F.size("abs") > 0)
        here = here.join(sets_of(here.select("rep").distinct()).withColumnRenamed("id", "rep"), "rep")
        askers = here.where(asks).withColumn("ab", place(41, ab)).where(F.array_contains("abs", F.col("ab"))).withColumn("db", F.explode(F.sequence(F.lit(0), db - 1)))
        others = here.withColumn("db", place(43, db)).withColumn("ab", F.explode("abs"))
        askers = askers.select(*[F.col(c).alias(f"q_{c}") for c in ("bucket", "ab", "db", "rep", "comp", "set")])
        others = others.select("bucket", "ab", "db", "rep", "comp", "set")
        return askers.groupBy("q_bucket", "q_ab", "q_db").cogroup(others.groupBy("bucket", "ab", "db")).applyInPandas(compare, f"a {kind}, b {kind}")

    return _one_by_one(spark, map(part, range(rounds)), rounds > 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest reachable id), kept (whether that is the document's own).

    Null, empty and blank texts have no shingle and are linked with nothing; a text of fewer words than a shingle has is
    one shingle. Rows with equal sets are linked whatever their number. A null id gets a null component and isn't kept.
    Rows are kept one for one (repeated rows of one id are alike); an empty table gives an empty result. If rows of one
    id have different texts, the one with the smallest digest of its set decides which component all of them are in.
    """
    release(spark)
    frequent = spark.sparkContext.broadcast(frequent_values(spark, docs, words, id_col, text_col))  # FREQUENT at most
    release(spark, wait=True)
    made = checkpoint(spark, sketches(spark, docs, words, percent, id_col, text_col, frequent))
    several = made.where("n > 0 and id is not null").groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("other"), F.count("*").alias("c")).where("c > 1")
    several = checkpoint(spark, several)
    repeated = bool(several.take(1))
    several = several.where("one <> other").select("id", "one")
    usable = made.where("n > 0 and id is not null")
    if several.take(1):
        made = made.join(several, "id", "left")
        usable = made.where("n > 0 and id is not null and (one is null or one = digest)").drop("one")
        made = made.withColumn("digest", F.when(F.col("n") > 0, F.coalesce("one", "digest")).otherwise(F.col("digest"))).drop("one")
    classes = usable.groupBy("digest").agg(F.min(F.struct("id", "n", "sketch")).alias("x")).select("digest", F.col("x.id").alias("rep"), F.col("x.n").alias("n"), F.col("x.sketch").alias("sketch"))
    classes = checkpoint(spark, classes)
    # sketches are held once: of the rows and, when pairs are found, of the classes only what names them stays
    made = checkpoint(spark, made.select("id", "n", "digest"))
    names = checkpoint(spark, classes.select("digest", "rep"))
    rounds = _rounds(classes.agg(F.sum(F.size("sketch"))).first()[0] or 0, VALUES)
    large = rounds > 1
    del usable, several
    release(spark, large)

    lists = _lists(spark, classes, rounds)
    long_lists = checkpoint(spark, lists.where(F.col("c") > SHORT).select("v", "rep").repartition("v", "rep"))  # no task reads a whole list
    in_long = long_lists.groupBy("rep").agg(F.count("*").alias("k"))
    short = checkpoint(spark, lists.where(F.col("c") <= SHORT).join(in_long, "rep", "left").select("v", "rep", "n", F.coalesce("k", F.lit(0)).alias("k")))
    del lists
    release(spark, large)
    rounds = _rounds(short.count(), MEETING)
    met = _one_by_one(spark, (_pairs_of(short, percent, rounds, i) for i in range(rounds)), rounds > 1)
    del short
    nth = Window.partitionBy("rep").orderBy("v")
    some = long_lists.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= LONG).join(in_long, "rep").select("v", "rep", "k")
    # a text whose whole sketch is in long lists has no part of its own: the middle of a group of copies
    middle = Window.partitionBy("v").orderBy(F.desc("k"), F.xxhash64("rep", "v"), "rep")
    chance = Window.partitionBy("v").orderBy(F.xxhash64("rep", "v"), "rep")
    pivots = some.withColumn("nth", F.row_number().over(middle)).where(F.col("nth") <= MIDDLE).select("v", F.col("rep").alias("pivot"))
    pivots = pivots.unionByName(some.withColumn("nth", F.row_number().over(chance)).where("nth = 1").select("v", F.col("rep").alias("pivot")))
    star = some.join(pivots, "v").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"), F.lit(1).alias("shared"), F.lit(True).alias("long"))

    def sets_of(reps: DataFrame) -> DataFrame:
        return checkpoint(spark, _full_sets(spark, docs, checkpoint(spark, names.join(reps, "rep", "left_semi").select("rep", "digest")), words, id_col, text_col, repeated))

    cand = met.unionByName(star).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("long").alias("long"))
    cand = checkpoint(spark, cand)
    del met, some, pivots, star
    hot = checkpoint(spark, _hot(cand))
    release(spark, large)
    if hot.count() <= BROADCAST_IDS:
        hot = F.broadcast(hot)
    pairs = cand.where("long").select("a", "b")
    ends = checkpoint(spark, pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct())
    known = classes.join(_small(ends), "rep", "left_semi")
    bounded = _cells(spark, pairs, SKETCHED, lambda cell: _bounded(spark, pairs, known, percent, hot, frequent, cell))
    del classes, known, ends
    # the most promising partners of each class; of a pivot, of each of its slices
    best = Window.partitionBy("b", "slice").orderBy(F.desc("shared"), "a")
    cand = cand.where("not long").select("a", "b", "shared").unionByName(bounded).join(hot.withColumnRenamed("end", "b"), "b", "left")
    cand = cand.withColumn("slice", F.pmod(F.xxhash64(F.lit(47), F.col("a")), F.coalesce("slices", F.lit(1)))).withColumn("nth", F.row_number().over(best))
    cand = checkpoint(spark, cand.select("a", "b", "shared", "nth"))
    release(spark, large)
    sets = sets_of(cand.select(F.col("a").alias("rep")).unionByName(cand.select(F.col("b").alias("rep"))).distinct())

    release(spark, large)
    first = cand.where(F.col("nth") <= PARTNERS)
    links = _cells(spark, first, CONFIRMED, lambda cell: _confirmed(first, sets, percent, hot, cell))
    comp = components(spark, links)
    crossing = _label(_label(cand.where(F.col("nth") > PARTNERS), comp, "a", "ca"), comp, "b", "cb").where("ca <> cb")
    crossing = checkpoint(spark, crossing.select("a", "b"))
    links = links.unionByName(_cells(spark, crossing, CONFIRMED, lambda cell: _confirmed(crossing, sets, percent, hot, cell)))
    comp = components(spark, links)
    del sets, cand, first, crossing
    release(spark, large)
    comp = components(spark, links.unionByName(_across_long_lists(spark, long_lists, comp, sets_of, percent)))

    labelled = _label(names, comp, "rep", "component").select("digest", "component")
    out = made.join(labelled, "digest", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
