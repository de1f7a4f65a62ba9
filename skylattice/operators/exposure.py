"""Live time of time slides for all lags at once, from occupancy bitmaps of window starts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.contracts import duplicates, failing, require
from skylattice.functions.columns import time_key
from skylattice.operators.graph import checkpoint
from skylattice.plans.ranking import renamed, same_keys

#: Places of a block, and lags of one block offset that a task adds up before it writes them.
BLOCK, HELD = 1 << 14, 64
YEAR = 365.25 * 86400


def _places(windows: DataFrame, step: float, keys: Sequence[str], start: str) -> DataFrame:
    """keys, residue of the start in steps, block and place in it. Only windows of one residue can be a whole number of steps apart."""
    unit = int(round(step * 1_000_000_000))
    key = time_key(F.col(start).cast("double"))
    at = F.floor(key / unit) if unit > 1 << 52 else (key - F.pmod(key, F.lit(unit))) / unit
    return windows.withColumns({"__residue": F.pmod(key, F.lit(unit)), "__at": F.floor(at).cast("bigint")}).withColumns({"__block": F.floor(F.col("__at") / BLOCK), "__place": F.pmod("__at", F.lit(BLOCK)).cast("int")})


def overlapping(windows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Pairs of windows of one duration that overlap; each is looked for in its own and the next stretch of that length."""
    length = windows.agg(F.max(F.col(end) - F.col(start))).scalar()
    at = windows.select(*keys, F.col(start).alias("__s"), F.floor(F.col(start) / length).alias("__b"), length.alias("__d"))
    near = at.withColumn("__b", F.explode(F.array("__b", F.col("__b") + 1)))
    lead = F.lead("__s").over(Window.partitionBy(*keys, "__b").orderBy("__s"))  # windows that don't overlap have two starts in two stretches
    return near.withColumn("__n", lead).where(F.col("__n") - F.col("__s") < F.col("__d")).select(*keys, F.col("__s").alias("start"), F.col("__n").alias("next")).distinct()


def lag_counts(windows: DataFrame, step: float, reference: str, shifted: str, keys: Sequence[str] = (), most: int | None = None, start: str = "gps_start", ifos: str = "ifos") -> DataFrame:
    """keys, lag, pairs: for every lag from 1 (to `most`) how many windows with the reference detector have a window with
    the shifted one that starts lag * step later; lags without a pair have no row. Starts must be unique within the keys.

    Starts become places on a grid and occupied places bitmaps of blocks. Two blocks give the counts of 2 * BLOCK lags at
    once, by a product of their Fourier transforms (whole numbers far below what doubles hold exactly). So the work goes with pairs of
    blocks that aren't empty, however many slides are asked for, and no window is joined with a window.
    """
    require(duplicates(windows, *keys, start), "windows repeat a start")
    placed = _places(windows, step, keys, start)

    def bitmap(ifo: str, name: str) -> DataFrame:
        return placed.where(F.array_contains(ifos, ifo)).groupBy(*keys, "__residue", "__block").agg(F.sort_array(F.collect_list("__place")).alias(name))

    a, b = (checkpoint(windows.sparkSession, bitmap(i, n)) for i, n in ((reference, "a"), (shifted, "b")))
    ends = placed.groupBy(*keys, "__residue").agg(F.min("__block").alias("__low"), F.max("__block").alias("__high"))
    reach = F.col("__high") if most is None else F.least(F.col("__high"), F.col("__block") + math.ceil(most / BLOCK))
    group = [*keys, "__residue"]
    ends, b = renamed(ends, group), renamed(b.withColumnRenamed("__block", "__of"), group)
    a = a.join(ends, same_keys(a, ends, group)).select(*a.columns, F.explode(F.sequence(F.col("__block"), F.greatest(F.col("__block"), reach))).alias("__to"))
    met = a.join(b, same_keys(a, b, group) & (F.col("__to") == F.col("__of"))).select(*keys, (F.col("__to") - F.col("__block")).alias("apart"), "a", "b")
    of_keys = [f"k{i}" for i in range(len(keys))]
    met = met.select(F.to_json(F.struct(*[F.col(k) for k in keys])).alias("of") if keys else F.lit("").alias("of"), F.struct(*[F.col(k).alias(n) for k, n in zip(keys, of_keys, strict=True)], F.lit(0).alias("z")).alias("key"), "apart", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        last: dict[str, object] = {}

        def rows() -> pa.RecordBatch:
            of, lag, n = [], [], []
            for (k, apart), counts in held.items():
                at = np.flatnonzero(counts)
                of += [last[k]] * len(at)
                lag.append(apart * BLOCK + at - (BLOCK - 1))
                n.append(counts[at])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(of, kind), pa.array(np.concatenate([np.zeros(0, np.int64), *lag])), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], ["key", "lag", "pairs"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("key").type
            for of, key, apart, x, y in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                p, q = np.zeros(BLOCK), np.zeros(BLOCK)
                p[BLOCK - 1 - np.array(x)], q[np.array(y)] = 1, 1  # the first one is turned round: a convolution counts differences
                both = np.fft.irfft(np.fft.rfft(p, 2 * BLOCK) * np.fft.rfft(q, 2 * BLOCK), 2 * BLOCK)
                counts = np.rint(both[: 2 * BLOCK - 1]).astype(np.int64)
                last[of] = key
                held[of, apart] = held[of, apart] + counts if (of, apart) in held else counts
                if len(held) > HELD:
                    yield rows()
        if held:
            yield rows()

    key_type = met.schema["key"].dataType.simpleString()
    out = met.mapInArrow(run, f"key {key_type}, lag long, pairs long").where("lag >= 1" if most is None else f"lag between 1 and {most}")
    return out.groupBy(*[F.col(f"key.{n}").alias(k) for n, k in zip(of_keys, keys, strict=True)], "lag").agg(F.sum("pairs").alias("pairs"))


def lag_exposure(windows: DataFrame, step: float, reference: str, shifted: str, keys: Sequence[str] = (), most: int | None = None, start: str = "gps_start", end: str = "gps_end", ifos: str = "ifos") -> DataFrame:
    """keys, lag, pairs, exposure: the counts with the live time that they stand for. Windows must be of one duration, not
    longer than the step, and mustn't overlap, so that the union of a lag's windows is their sum."""
    require(failing(windows, interval=F.col(end) > F.col(start)).select(start), "a window has no length")
    ends = windows.agg(F.min(F.col(end) - F.col(start)).alias("least"), F.max(F.col(end) - F.col(start)).alias("most")).first()
    require(windows.where(F.lit(ends["least"] != ends["most"])), "windows have more than one duration")
    require(windows.where(F.lit((ends["most"] or 0) > step)), "a window is longer than the step")
    require(overlapping(windows, keys, start, end), "windows overlap")
    return lag_counts(windows, step, reference, shifted, keys, most, start, ifos).withColumn("exposure", F.col("pairs") * F.lit(ends["most"] or 0))


def exposure_plan(exposure: DataFrame, windows: int, duration: float, target: float, confidence: float = 0.9, year: float = YEAR) -> DataFrame:
    """One row: lags with a pair, pairs, their live time, the rate that no count at all would exclude at the confidence,
    the live time that the target rate (a year) asks for and the share of it that is there, and how many windows would do
    if every two of them could be paired."""
    need = -math.log(1 - confidence) / target * year
    total = exposure.agg(F.count("*").alias("lags"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("exposure"), F.lit(0)).cast("double").alias("live_time"))
    limit: Column = F.when(F.col("live_time") > 0, -math.log(1 - confidence) / (F.col("live_time") / year))
    return total.withColumns({"windows": F.lit(windows), "rate_limit": limit, "needed_time": F.lit(need), "share": F.col("live_time") / need, "reached": F.col("live_time") >= need, "least_windows": F.lit(math.ceil((1 + math.sqrt(1 + 8 * need / duration)) / 2))})
