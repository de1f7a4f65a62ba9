"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import doc_crc, small_batches

#: Hashed features; labelled rows to learn from at most (documented bound); passes over them.
BITS, SAMPLE, PASSES = 22, 24_000, 6
#: A strong L1 leaves about a thousand weights; chosen on rows held out from learning.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2.5, 0.1
WORD = re.compile(r"[^\W_]+")
#: Distinct words whose hashes a worker keeps.
KEPT = 200_000


def held_out(doc_id: Column) -> Column:
    return F.pmod(doc_crc(doc_id), F.lit(5)) == 0


class Features:
    """Hashed unigrams, bigrams and pairs with one or two words between, of whole texts."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = np.uint64((1 << bits) - 1), {}

    def words(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        known = self.known
        if len(known) > KEPT:
            known.clear()
        for w in set(found).difference(known):
            b = w.encode()
            known[w] = zlib.crc32(b) | zlib.adler32(b) << 32
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def _mix(self, x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and the text each belongs to, with repeats."""
        per_text = [self.words(t) for t in texts]
        n = np.array([len(x) for x in per_text], np.int64)
        w = np.concatenate(per_text) if per_text else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), n)
        features, owners = [self._mix(w)], [owner]
        for gap in (1, 2, 3):
            if len(w) > gap:
                same = owner[gap:] == owner[:-gap]
                pair = w[:-gap][same] * np.uint64(0xD6E8FEB86659FD93) + w[gap:][same] + np.uint64(gap)
                features.append(self._mix(pair))
                owners.append(owner[gap:][same])
        return np.concatenate(features).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """Per-coordinate learning rates and L1 sparsity; one example at a time."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, features: np.ndarray, label: int) -> None:
        z, n = self.z[features], self.n[features]
        w = self.weights(z, n)
        bias = self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
        g2 = g * g
        self.z[features] = z + g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[features] = n + g2
        self.bias_z += g - ((self.bias_n + g2) ** 0.5 - self.bias_n**0.5) / self.alpha * bias
        self.bias_n += g2


def score_texts(f: Features, dense: np.ndarray, bias: float, texts: list[str]) -> np.ndarray:
    """Probability of label 1. A feature counts once a text; features without weight are dropped before that."""
    feature, owner = f.of(texts)
    some = dense[feature] != 0
    once = np.unique(owner[some] << BITS | feature[some])
    total = np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, weights and bias, learned from at most `sample` labelled rows (by hash of the id), whole texts.

    Features are made where the texts are, of one row for each id (the smallest text, if rows of one id differ). One
    task then learns from the bounded sample in hash order and returns only the weights that L1 leaves; it takes as long
    whatever the number of documents is.
    """
    small_batches(spark, 64)
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    rows = docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")  # `sample` rows of two numbers
    rows = rows.groupBy("__id", "label").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            found = [np.unique(f.of([t])[0]).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["h", "label", "features"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = Ftrl(), []
        for batch in batches:
            flat, at = batch.column(1).values.to_numpy(), np.asarray(batch.column(1).offsets)
            for i, y in enumerate(batch.column(0).to_pylist()):
                kept.append((flat[at[i] : at[i + 1]].copy(), y))
                model.learn(*kept[-1])
        for _ in range(PASSES - 1):
            for x, y in kept:
                model.learn(x, y)
        w = model.weights(model.z, model.n)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*w[at].tolist(), model.bias()], pa.float64())], ["feature", "weight"])

    made = rows.select(F.xxhash64("__id").alias("h"), "label", "text").mapInArrow(featured, "h long, label int, features array<int>")
    ordered = made.repartition(1).sortWithinPartitions("h", "features").select("label", "features")
    got = ordered.mapInArrow(run, "feature long, weight double").collect()
    at = np.array([r["feature"] for r in got], np.int64)
    w = np.array([r["weight"] for r in got], np.float64)
    return at[at >= 0], w[at >= 0], float(w[at < 0].sum())


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """All columns of docs, then __toxic_score (0 to 1) and __toxic (1 if the score is 0.5 or more).

    Null and empty texts get the score of the bias alone. Without labelled rows there is nothing to learn from: every
    score is 1 / (1 + e) = 0.27, and no document is toxic. Labels, language, source and id are no inputs of a score.
    Rows are kept one for one, repeated ones too; an empty table gives an empty result. Columns of the input named
    __toxic_score or __toxic are replaced.
    """
    at, w, bias = train(spark, docs, labels, id_col, text_col, sample)
    if not len(at) and bias == 0:
        bias = -1.0  # nothing is known of toxic texts
    model = spark.sparkContext.broadcast((at, w, bias))  # what L1 leaves; bounded by the sample
    held: dict = {}

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, bias = model.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        f = held.setdefault("features", Features())
        for t in texts:
            yield pa.array(score_texts(f, dense, bias, [x or "" for x in t.to_pylist()]), pa.float64())

    score = F.arrow_udf(predict, "double", F.ArrowUDFType.SCALAR_ITER)
    small_batches(spark, 64)
    return docs.withColumn("__toxic_score", score(docs[text_col])).withColumn("__toxic", (F.col("__toxic_score") >= 0.5).cast("int"))


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = toxicity(spark, docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__toxic_score").alias("score"), F.col("__toxic").alias("predicted"))
