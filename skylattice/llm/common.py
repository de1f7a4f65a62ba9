"""What the operators of this subpackage share: reading tables, Arrow batches of bounded size, stable hashes."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name, for SQL trims and for byte scans.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Batches that go to Python hold few rows, so that a worker's memory doesn't depend on how long texts are.

    Text columns vary from nothing to hundreds of kilobytes a row; Spark's default of 10,000 rows a batch would put
    a gigabyte of long texts into one Python worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session may do without: it gets a folder
    of its own, since driver and tasks are one process there."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set; it must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of the session."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession, wait: bool = False) -> None:
    """Let Spark's cleaner remove the shuffle files of steps that are written and out of reach. It acts when the driver
    collects garbage, which a driver with little to do doesn't for minutes, while files of many small steps add up.

    The JVM hears of frames that Python dropped from a thread that looks once a second. With `wait` they go now, without
    it possibly at the next call only, which is soon enough where files are small.
    """
    gc.collect()
    if wait:
        time.sleep(1.1)
    spark.sparkContext._jvm.System.gc()


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def grouped_by_size(items: Iterable[tuple[int, object]], most: int) -> Iterator[list[object]]:
    """Consecutive items in lists whose sizes add up to about `most`; an item larger than that is alone."""
    held: list[object] = []
    total = 0
    for size, x in items:
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(x)
        total += size
    if held:
        yield held
