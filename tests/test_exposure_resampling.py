"""Lag counts against all pairs, plans by hand, and resamples that draw exactly as many rows as there are."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.contracts import ContractError
from skylattice.operators import evaluation, exposure, resampling, search

WINDOWS = "window_id string, gps_start long, gps_end long, ifos array<string>"


def windows(spark, rows):
    return spark.createDataFrame([(f"w{s}", s, s + d, list(i)) for s, d, i in rows], WINDOWS)


@pytest.mark.parametrize("block", [1 << 14, 8])
def test_counts_of_all_lags_equal_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(exposure, "BLOCK", block)
    monkeypatch.setattr(exposure, "HELD", 2)
    r = random.Random(7)
    starts = sorted(r.sample(range(-400, 3000), 250))
    rows = [(s * 4, 4, r.choice([["H"], ["L"], ["H", "L"], ["V"]])) for s in starts]
    want = Counter((b[0] - a[0]) // 8 for a in rows for b in rows if b[0] > a[0] and (b[0] - a[0]) % 8 == 0 and "H" in a[2] and "L" in b[2])
    df = windows(spark, rows)
    got = {x["lag"]: x["pairs"] for x in exposure.lag_counts(df, 8, "H", "L").collect()}
    assert got == dict(want)
    few = {x["lag"]: (x["pairs"], x["exposure"]) for x in exposure.lag_exposure(df, 8, "H", "L", most=37).collect()}
    assert few == {k: (v, 4 * v) for k, v in want.items() if k <= 37}
    pairs = search.slide_exposure(search.window_pairs(df, search.slide_table(spark, 1, 37, 8), "H", "L"))
    assert few == {x["slide"]: (x["paired_windows"], x["exposure"]) for x in pairs.collect()}


def test_counts_by_key_and_hand_values(spark):
    rows = [(0, 8, ["H", "L"]), (8, 8, ["H", "L"]), (16, 8, ["H", "L"]), (24, 8, ["H", "L"])]
    df = windows(spark, rows)
    got = exposure.lag_exposure(df, 8, "H", "L")
    assert {x["lag"]: x["pairs"] for x in got.collect()} == {1: 3, 2: 2, 3: 1} and got.agg(F.sum("exposure")).first()[0] == 48
    both = df.withColumn("run", F.lit("a")).unionByName(df.where("gps_start > 0").withColumn("run", F.lit(None).cast("string")))
    assert {(x["run"], x["lag"]): x["pairs"] for x in exposure.lag_counts(both, 8, "H", "L", ["run"]).collect()} == {("a", 1): 3, ("a", 2): 2, ("a", 3): 1, (None, 1): 2, (None, 2): 1}
    plan = exposure.exposure_plan(got, 4, 8.0, 0.2).first()
    assert (plan["lags"], plan["pairs"], plan["live_time"], plan["reached"]) == (3, 6, 48.0, False) and plan["least_windows"] == pytest.approx((2 * plan["needed_time"] / 8) ** 0.5 + 0.5, abs=1)
    assert exposure.lag_counts(df.where("gps_start = 0"), 8, "H", "L").count() == 0 and exposure.lag_counts(df.limit(0), 8, "H", "L").count() == 0


@pytest.mark.parametrize("rows", [[(0, 8, ["H"]), (0, 8, ["L"])], [(0, 8, ["H"]), (4, 8, ["L"])], [(0, 8, ["H"]), (16, 4, ["L"])], [(0, 16, ["H"])], [(0, 0, ["H"])], [(7, 8, ["H"]), (8, 8, ["H"])]])
def test_windows_that_exposure_refuses(spark, rows):
    df = windows(spark, rows).withColumn("window_id", F.monotonically_increasing_id())
    with pytest.raises(ContractError):
        exposure.lag_exposure(df, 8, "H", "L").collect()


@pytest.mark.parametrize("cell", [2048, 5])
def test_each_resample_draws_all_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(resampling, "CELL", cell)
    monkeypatch.setattr(resampling, "BITS", 3)
    r = random.Random(2)
    rows = [(k, i, r.gauss(3, 1)) for k, n in (("a", 400), (None, 37), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    sums = {"s": F.col("v"), "n": F.lit(1.0)}
    a, b = (sorted(((x["k"] or "~", x["replicate"], x["draws"], x["n"], round(x["s"], 6)) for x in resampling.replicate_sums(d, ["k"], "id", sums, 200, 4).collect())) for d in (df, df.repartition(7).orderBy("v")))
    assert a == b and len(a) == 600
    for k, n in (("a", 400), ("~", 37), ("one", 1)):
        own = [x for x in a if x[0] == k]
        assert all(x[2] == x[3] == n for x in own)
        v = np.array([x for q, _, x in rows if (q or "~") == k])
        s = np.array([x[4] for x in own])
        assert abs(s.mean() - v.sum()) <= 5 * (v.std() * n**0.5 / 200**0.5 + 1e-6)
        assert n == 1 or s.std() == pytest.approx(v.std() * n**0.5, rel=0.25)


def test_intervals_of_paired_arms(spark):
    r = np.random.default_rng(3)
    n = 500
    a, b, w, s = r.random(n) < 0.4, r.random(n) < 0.5, r.uniform(0.5, 2, n), r.integers(0, 2, n)
    df = spark.createDataFrame([(i, bool(x), bool(y), float(z), f"s{k}") for i, (x, y, z, k) in enumerate(zip(a, b, w, s))], "id long, a boolean, b boolean, w double, s string")
    got = {x["s"]: x for x in evaluation.paired_arms(df, F.col("a"), F.col("b"), F.col("w"), "s", "id", 600, 1).collect()}
    change = w * (b.astype(float) - a.astype(float))
    for k, x in ((None, change), ("s0", change[s == 0]), ("s1", change[s == 1])):
        i = r.integers(0, len(x), (4000, len(x)))
        low, high = np.percentile(x[i].sum(1), [2.5, 97.5])
        assert got[k]["delta"] == pytest.approx(x.sum()) and [got[k]["boot_low"], got[k]["boot_high"]] == pytest.approx([low, high], abs=0.15 * (high - low))
