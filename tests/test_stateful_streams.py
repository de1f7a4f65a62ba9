"""Restarts, changed identities, late rows, and live time in any order, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from skylattice.operators import audits
from skylattice.contracts import ContractError
from skylattice.plans import joins
from skylattice.streaming import stateful

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
at = lambda s: T0 + timedelta(seconds=s)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)


def feed(spark, folder, schema, make):
    """run(rows): appends rows to the source, runs the query until all is read, and returns what it has put out since."""
    source, out, seen = f"{folder}/in", f"{folder}/out", set()

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = make(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(out).collect()]
        new = list(got)
        for x in seen_list:
            new.remove(x)
        seen_list.extend(new)
        return sorted(new, key=repr)

    seen_list: list = []
    return run


def test_runs_keep_identity_and_progress_over_restarts(rocks, tmp_path):
    schema = "run string, id string, model string, t timestamp"
    run = feed(rocks, tmp_path, schema, lambda s: stateful.resumable_runs(s, "run", "id", "model", "t", "20 seconds", 60))
    assert run([("a", "1", "m1", at(0)), ("a", "2", "m1", at(1)), ("b", "1", "m9", at(0)), (None, "1", "m1", at(0))]) == [("a", "1", "accepted", 1), ("a", "2", "accepted", 2), ("b", "1", "accepted", 1)]
    # a restart: repeated rows, a changed identity, a late shard within the watermark
    assert run([("a", "2", "m1", at(1)), ("a", "3", "m1", at(5)), ("a", "4", "m2", at(6)), ("b", "2", "m9", at(2))]) == [("a", "2", "repeated", 2), ("a", "3", "accepted", 3), ("a", "4", "refused", 3), ("b", "2", "accepted", 2)]
    # time moves on: ids are forgotten, runs without any are closed, rows behind the watermark are dropped
    out = run([("c", "1", "m1", at(500))]) + run([("c", "2", "m1", at(501)), ("a", "9", "m1", at(7))])
    assert ("a", None, "closed", 3) in out and ("b", None, "closed", 2) in out and ("c", "2", "accepted", 2) in out and not any(x[1] == "9" for x in out)
    assert ("a", "5", "accepted", 1) in run([("a", "5", "m2", at(505))])  # a new run of the name


def union(intervals):
    s, e = stateful.merged(*(__import__("numpy").array(x) for x in zip(*intervals)))
    return int((e - s).sum())


@pytest.mark.parametrize("seed", [1, 2])
def test_live_time_in_any_order(rocks, tmp_path, seed):
    r = random.Random(seed)
    schema = "ifo string, s timestamp, e timestamp"
    run = feed(rocks, tmp_path, schema, lambda x: stateful.live_exposure(x, "ifo", "s", "e", "100 seconds"))
    rows = {"H": [], "L": []}
    total = {"H": 0, "L": 0}
    for batch in range(4):
        new = []
        for _ in range(12):
            k, a = r.choice("HL"), batch * 90 + r.randint(0, 110)
            b = a + r.choice([1, 5, 30])
            rows[k].append((a, b))
            new.append((k, at(a), at(b)))
        for k, change, live, _ in run([*new, ("H", at(5), at(5)), (None, at(1), at(2)), ("L", at(3), None)]):
            total[k] += change
            assert live == total[k]
        for k, own in rows.items():
            assert total[k] == (union(own) * 1_000_000 if own else 0)


def test_islands_that_nothing_reaches_become_a_number(rocks, tmp_path):
    schema = "ifo string, s timestamp, e timestamp"
    run = feed(rocks, tmp_path, schema, lambda x: stateful.live_exposure(x, "ifo", "s", "e", "10 seconds"))
    assert run([("H", at(0), at(4)), ("H", at(6), at(8)), ("H", at(3), at(5))]) == [("H", 7_000_000, 7_000_000, 2)]
    run([("H", at(1000), at(1001))])
    run([("H", at(1002), at(1003))])
    assert run([("H", at(1004), at(1005))]) == [("H", 1_000_000, 10_000_000, 3)]  # the first two islands are settled
    assert run([("H", at(3), at(900)), ("H", at(1005), at(1006))])[0][1:3] == (1_000_000, 11_000_000)  # far too late


def test_overlaps_of_many_manifests(spark):
    r = random.Random(4)
    names = [f"m{i}" for i in range(9)]
    values = {n: [(str(r.randint(0, 30)) if r.random() < 0.9 else None, r.randint(0, 9)) for _ in range(25)] for n in names}
    frames = {n: spark.createDataFrame(v, "a string, b int") for n, v in values.items()}
    frames["bare"] = spark.createDataFrame([(1,)], "c int")
    got = {(x["field"], x["left"], x["right"]): x["shared"] for x in audits.manifest_overlaps(frames, ["a", "b"]).collect()}
    sets = {(f, n): {str(x[i]) for x in values[n] if x[i] is not None} for i, f in enumerate("ab") for n in names}
    want = {(f, m, n): len(sets[f, m] & sets[f, n]) for f in "ab" for i, m in enumerate(names) for n in names[i:]}
    assert got == {k: v for k, v in want.items() if v}


def test_a_locked_manifest_shares_nothing(spark):
    m = {"locked": spark.createDataFrame([("a", 1), (None, 2)], "x string, y int"), "one": spark.createDataFrame([("b", 3)], "x string, y int"), "two": spark.createDataFrame([("b",)], "x string")}
    assert sorted(tuple(r) for r in audits.require_disjoint(m, "locked", ["x", "y"]).collect()) == [("x", "one", 0), ("x", "two", 0), ("y", "one", 0)]
    with pytest.raises(ContractError, match="shares"):
        audits.require_disjoint(m | {"three": m["locked"].where("y = 2")}, "locked", ["x", "y"])
    with pytest.raises(ContractError, match="nothing to compare"):
        audits.require_disjoint(m | {"three": spark.createDataFrame([(None,)], "x string")}, "locked", ["x", "y"])


def test_the_last_row_of_a_catalog_counts(spark):
    left, right = spark.createDataFrame([("e1",), ("e2",)], "e string"), spark.createDataFrame([("e1", 9.0, 0), ("e1", 2.0, 1)], "k string, snr double, line int")
    assert sorted(tuple(r) for r in joins.matched(left, right, "e", "k", "line").collect()) == [("e1", True, 2.0), ("e2", False, None)]


def test_coincidences_of_two_streams_equal_those_of_tables(rocks, tmp_path):
    """Clusters that come out of the streams, batch by batch, are those of the whole tables."""
    from skylattice.streaming import ingest

    r = random.Random(6)
    schema = "slide int, id string, t timestamp, score double"
    rows = {d: [(r.randint(0, 1), f"{d}{k}", at(round(r.uniform(0, 900), 3)), round(r.random(), 6)) for k in range(120)] for d in "ab"}
    whole = {d: rocks.createDataFrame(rows[d], schema) for d in "ab"}
    want = sorted(tuple(x) for x in ingest.coincidences(whole["a"], whole["b"], "t", "score", "id", 2.0, "5 seconds", "30 seconds", "slide").collect())
    pairs = [(a, b) for a in rows["a"] for b in rows["b"] if a[0] == b[0] and abs((a[2] - b[2]).total_seconds()) <= 2]
    assert sum(x[3] for x in want) == len(pairs) > 20 and max(x[3] for x in want) > 1
    queries = None
    for d in "ab":
        rows[d].sort(key=lambda x: x[2])
    for step in range(4):
        for d in "ab":
            part = rows[d][step * 30 : step * 30 + 30] if step < 3 else rows[d][90:] + [(9, "end", at(5000), 0.0)]
            r.shuffle(part)
            rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{d}")
        streams = [rocks.readStream.schema(schema).parquet(f"{tmp_path}/{d}") for d in "ab"]
        out = ingest.coincidences(*streams, "t", "score", "id", 2.0, "5 seconds", "30 seconds", "slide")
        queries = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        queries.awaitTermination()
    got = sorted(tuple(x) for x in rocks.read.parquet(f"{tmp_path}/out").collect())
    assert [x for x in got if x[0] != 9] == want


@pytest.mark.parametrize("each", [1 << 16, 3])
def test_packing_equals_the_loop(spark, each):
    from skylattice.operators import packing

    r = random.Random(each)
    for capacity, n in ((1, 20), (7, 250), (50, 40)):
        sizes = [r.randint(1, capacity + (2 if capacity > 1 else 0)) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(sizes)), "i int, n int").repartition(5)
        got = {x["i"]: x["shard"] for x in packing.next_fit(spark, df, ["i"], "n", capacity, each).collect()}
        shard, used, want = 0, 0, {}
        for i, k in enumerate(sizes):
            if used and used + k > capacity:
                shard, used = shard + 1, 0
            used += k
            want[i] = shard
        assert got == want
    assert packing.next_fit(spark, df.limit(0), ["i"], "n", 5).count() == 0
