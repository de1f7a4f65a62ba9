"""Runs in long profiles that come as arrays, piece by piece."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def profile_runs(df: DataFrame, keys: Sequence[str], start: str, values: str, threshold: float, least: int = 1) -> DataFrame:
    """keys, first, last, length, peak, peak_value: runs of at least `least` neighbouring values at or above the threshold.

    A row is a piece of its key's profile: the position of its first value, and the values. A table function goes through
    the pieces of a key in order and carries the run that is open from one to the next, so a run may be longer than any
    piece and only one piece is in memory; a piece that doesn't begin where the last one ended closes the run. Null and NaN
    are below any threshold, the first of the largest values is the peak, pieces without values or start have no effect,
    and pieces that overlap are an error. Rows equal those of `intervals.threshold_runs` on one row for each value.
    """
    if least < 1:
        raise ValueError("a run has at least one value")
    pieces = df.where(F.col(start).isNotNull() & (F.size(values) > 0)).select(*keys, F.col(start).cast("bigint").alias("__start"), F.col(values).cast("array<double>").alias("__values"))
    runs = StructType([pieces.schema[k] for k in keys])
    for name, kind in {"first": "long", "last": "long", "length": "long", "peak": "long", "peak_value": "double"}.items():
        runs = runs.add(name, kind)

    class Runs:
        def __init__(self) -> None:
            self.key: tuple = ()
            self.run: tuple | None = None  # first, peak, peak_value
            self.next: int | None = None

        def closed(self, last: int) -> list[tuple]:
            first, peak, value = self.run
            self.run = None
            length = last - first + 1
            return [(*self.key, first, last, length, peak, value)] if length >= least else []

        def eval(self, row):  # noqa: ANN001, ANN202
            self.key, at = tuple(row[k] for k in keys), row["__start"]
            if self.next is not None and at < self.next:
                raise ValueError(f"the piece at {at} overlaps the one before it")
            if self.run is not None and at > self.next:
                yield from self.closed(self.next - 1)
            x = np.array([np.nan if v is None else v for v in row["__values"]])
            above = np.concatenate([[False], x >= threshold, [False]])
            edges = np.flatnonzero(above[1:] != above[:-1]).reshape(-1, 2)
            if self.run is not None and not above[1]:
                yield from self.closed(at - 1)
            for i, j in edges.tolist():
                best = i + int(np.argmax(x[i:j]))
                if i or self.run is None:
                    self.run = (at + i, at + best, float(x[best]))
                elif x[best] > self.run[2]:
                    self.run = (self.run[0], at + best, float(x[best]))
                if j < len(x):
                    yield from self.closed(at + j - 1)
            self.next = at + len(x)

        def terminate(self):  # noqa: ANN202
            if self.run is not None:
                yield from self.closed(self.next - 1)

    table = pieces.asTable()
    table = table.partitionBy(*keys).orderBy("__start") if keys else table.withSinglePartition().orderBy("__start")
    return F.udtf(Runs, returnType=runs)(table)
