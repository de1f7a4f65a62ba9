"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and returns a DataFrame that is written and
read again as the docs of the next stage. All but the last return the columns of `documents`. Nulls in any column,
empty texts, repeated rows and empty tables pass through every stage as the operators' docstrings say. More columns in
the input are dropped at the first stage.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import bpe_codec, line_dedup, mixing, near_dedup, toxicity
from skylattice.llm.common import checkpoint, release, shared_folder, table
from skylattice.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; all others stay as they are."""
    docs = docs.select(*COLUMNS)
    return toxicity.toxicity(spark, docs, table(spark, sf_dir, "labels")).where("__toxic = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that are in three documents or more stay only in the one with the largest id.
    n_chars follows the text; a document all of whose lines go stays, with an empty text."""
    out = line_dedup.drop_repeated_lines(spark, docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words to a shingle, similarity 0.8 or more, the smallest id. Texts without
    a word are in no group and stay; documents without an id can't be told apart and stay too."""
    docs = docs.select(*COLUMNS)
    near = near_dedup.near_duplicates(spark, docs, words=5, percent=80)
    gone = checkpoint(spark, near.where("not kept and doc_id is not null").select("doc_id").distinct())
    del near
    release(spark)
    if gone.count() <= near_dedup.BROADCAST_IDS:
        gone = F.broadcast(gone)  # so texts aren't shuffled
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (none to three times). Rows of one id and rows without an id are
    documents of their own; a number of its own for each row, written beside it, brings its copies back to it."""
    rows = checkpoint(spark, docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()))
    copies = mixing.mix(spark, rows, carry="__row").where("copies > 0").select("__row", "copies")
    repeated = rows.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for each document of the mix."""
    return bpe_codec.round_trip(spark, docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Classifier, near-duplicates and the cube method are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what a stage returned goes when the
    next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        release(spark, wait=True)
        if i:
            _remove(spark, f"{folder}/{i - 1}")
    return docs
