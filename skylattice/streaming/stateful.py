"""Streams with a state of their own: scoring runs that keep their identity and progress, and live time as it comes in.

Both use transformWithState, which needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Event
time and a watermark bound the state: timers clear what no row can reach any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICRO = 1_000_000


def _millis(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[ms]").astype(np.int64)


class _Run(StatefulProcessor):
    """State of a run: its identity, rows done, and the ids of rows that may still come again."""

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "identity string, done long")
        self.seen = handle.getMapState("seen", "id string", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.sort_values(["time", "id"], kind="stable")
            identity, done = self.run.get() if self.run.exists() else (pdf["identity"].iloc[0], 0)
            status, progress = [], []
            for i, who, at in zip(pdf["id"], pdf["identity"], _millis(pdf["time"]).tolist(), strict=True):
                if who != identity:
                    status.append("refused")
                elif self.seen.containsKey((i,)):
                    status.append("repeated")
                else:
                    status.append("accepted")
                    done += 1
                    self.seen.updateValue((i,), (at,))
                    self.handle.registerTimer(at + self.kept)
                progress.append(done)
            self.run.update((identity, done))
            yield pd.DataFrame({"run": key[0], "id": pdf["id"].to_numpy(), "status": status, "done": progress})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs() - self.kept
        for k, v in list(self.seen.iterator()):
            if v[0] <= limit:
                self.seen.removeKey(k)
        if not self.seen.exists():
            identity, done = self.run.get()
            self.run.clear()
            yield pd.DataFrame({"run": [key[0]], "id": [None], "status": ["closed"], "done": [done]})

    def close(self) -> None:
        pass


def resumable_runs(stream: DataFrame, run: str, row: str, identity: str, time: str, late: str, kept_seconds: int) -> DataFrame:
    """run, id, status, done of each row: whether a scoring run takes it.

    The first row of a run settles its identity (of model, configuration and inputs). Rows of the same identity are
    `accepted` once and `repeated` when they come again; rows of another identity are `refused`. done counts accepted
    rows, so progress survives restarts from the stream's checkpoint. An id is remembered for kept_seconds of event
    time; a run all of whose ids are forgotten is `closed` and its state goes, so a later run of the name may have
    another identity. Rows later than the watermark are dropped by Spark. Null runs, ids and times aren't taken.
    """
    rows = stream.select(F.col(run).cast("string").alias("run"), F.col(row).cast("string").alias("id"), F.coalesce(F.col(identity).cast("string"), F.lit("")).alias("identity"), F.col(time).alias("time"))
    rows = rows.where("run is not null and id is not null and time is not null").withWatermark("time", late)
    return rows.groupBy("run").transformWithStateInPandas(_Run(kept_seconds * 1000), "run string, id string, status string, done long", "append", "EventTime")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as islands; those that touch are one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(s) - 1]])
    return s[first], e[last]


class _Live(StatefulProcessor):
    """State of a detector: the islands that late intervals may still reach, and the length of all others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.islands = handle.getMapState("islands", "start long", "end long")
        self.settled = handle.getValueState("settled", "length long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            known = [(k[0], v[0]) for k, v in self.islands.iterator()]
            old = np.array(known, np.int64).reshape(-1, 2)
            s, e = merged(np.concatenate([old[:, 0], pdf["start"].to_numpy(np.int64)]), np.concatenate([old[:, 1], pdf["end"].to_numpy(np.int64)]))
            before, now = dict(known), dict(zip(s.tolist(), e.tolist(), strict=True))
            for a in before.keys() - now.keys():
                self.islands.removeKey((a,))
            for a, b in now.items():
                if before.get(a) != b:
                    self.islands.updateValue((a,), (b,))
                    self.handle.registerTimer(b // 1000 + 1)
            settled = self.settled.get()[0] if self.settled.exists() else 0
            was, live = int((old[:, 1] - old[:, 0]).sum()), int((e - s).sum())
            if live != was or not known:
                yield pd.DataFrame({"ifo": [key[0]], "change": [live - was], "live_time": [settled + live], "islands": [len(s)]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        length = self.settled.get()[0] if self.settled.exists() else 0
        for k, v in list(self.islands.iterator()):
            if v[0] < limit:  # rows that start before the watermark don't come any more
                length += v[0] - k[0]
                self.islands.removeKey(k)
        self.settled.update((length,))
        yield from ()

    def close(self) -> None:
        pass


def live_exposure(stream: DataFrame, ifo: str, start: str, end: str, late: str) -> DataFrame:
    """ifo, change, live_time, islands: after each batch, by how much the union of a detector's intervals [start, end) has
    changed (in microseconds) and what it is; `change` retracts what intervals that came before had counted twice.

    Intervals may come in any order, by at most `late`: only islands that such intervals can still reach are kept, the
    rest is a number. Null and empty intervals don't count. The sum of changes is the union's length at any time.
    """
    rows = stream.select(F.col(ifo).cast("string").alias("ifo"), F.col(start).alias("time"), F.unix_micros(start).alias("start"), F.unix_micros(end).alias("end"))
    rows = rows.where("ifo is not null and start < end").withWatermark("time", late)
    return rows.groupBy("ifo").transformWithStateInPandas(_Live(), "ifo string, change long, live_time long, islands long", "append", "EventTime")
