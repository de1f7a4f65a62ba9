"""Thresholds, quantiles and running sums against plain Python, with limits so small that every path is taken."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.contracts import ContractError
from skylattice.operators import stats
from skylattice.plans import order_statistics, ranking


def made(seed=5, n=600):
    r = random.Random(seed)
    kinds = {"spread": lambda: r.gauss(0, 1e3), "ties": lambda: float(r.randint(0, 4)), "heavy": lambda: math.exp(r.uniform(-300, 300)), None: lambda: -abs(r.gauss(0, 1))}
    rows = [(k, f()) for k, f in kinds.items() for _ in range(n)]
    return rows + [("one", 2.0), ("spread", None), ("none", None)]


def brute(values, most):
    for t in sorted(set(values)):
        if sum(v >= t for v in values) <= most:
            return t, sum(v >= t for v in values)
    return float(np.nextafter(max(values), math.inf)), 0


def by_key(rows):
    out = {}
    for k, v in rows:
        if v is not None:
            out.setdefault(k, []).append(v)
    return out


@pytest.mark.parametrize("whole", [1_000_000, 7])
def test_smallest_passed_by(spark, whole):
    rows = made()
    df = spark.createDataFrame(rows, "k string, s double")
    for most in (0, 25) if whole == 7 else (1, 25, 599, 600):
        got = {r["k"]: (r["threshold"], r["survivors"]) for r in order_statistics.smallest_passed_by(df, ["k"], "s", F.lit(most), whole).collect()}
        assert got == {k: brute(v, most) for k, v in by_key(rows).items()}, most


@pytest.mark.parametrize("whole", [1_000_000, 7])
def test_quantiles(spark, whole):
    rows = made(6)
    df = spark.createDataFrame(rows, "k string, s double")
    shares = [0.0, 0.05, 0.5, 0.777, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(5)] for r in order_statistics.quantiles(df, ["k"], "s", shares, whole).collect()}
    want = {k: np.quantile(v, shares).tolist() for k, v in by_key(rows).items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9), k


def test_next_double_is_the_next(spark):
    r = random.Random(1)
    xs = [s * 2.0**e for e in range(-1019, 1023) for s in (1, -1)] + [r.gauss(0, 1) * 10.0 ** r.randint(-300, 300) for _ in range(3000)] + [0.0, -0.0, 5e-324, -5e-324, 1e-320, 1.7e308, -1.7e308]
    xs += [float(np.nextafter(x, d)) for x in xs[:4000] for d in (math.inf, -math.inf)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", order_statistics.next_double(F.col("x")).alias("y")).collect()
    assert all(g["y"] == np.nextafter(g["x"], math.inf) for g in got)


@pytest.mark.parametrize("top", [2.0**-31, -2.0, -1.0, -0.5, 0.0, 4.0])
def test_nothing_reaches_the_threshold_of_none(spark, top):
    df = spark.createDataFrame([("a", top), ("a", top)], "k string, s double")
    got = stats.threshold_at_count(df, ["k"], "s", 1).first()
    assert got["threshold"] == np.nextafter(top, math.inf) and got["survivors"] == 0


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_scores_that_are_not_finite_are_refused(spark, bad):
    df = spark.createDataFrame([("a", 1.0), ("a", bad)], "k string, s double")
    for f in (lambda: stats.threshold_at_count(df, ["k"], "s", 1), lambda: stats.threshold_at_rate(df, ["k"], "s", F.lit(1.0), 1.0), lambda: order_statistics.quantiles(df, ["k"], "s", [0.5])):
        with pytest.raises(ContractError):
            f()


def test_rates_at_the_edge_of_division(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(40)], "k string, s double")
    for live in (0.1, 1 / 3, 10.0):
        for target in (0.3, 3.0, 29.999999999999996):
            most = max(i for i in range(-1, 41) if i / live <= target)
            got = stats.threshold_at_rate(df, ["k"], "s", F.lit(live), target).first()
            assert got["survivors"] == min(most, 40) and (got["far"] <= target or most < 0)


def test_a_key_without_scores_or_a_table_without_rows(spark):
    none = spark.createDataFrame([], "k string, s double")
    assert stats.threshold_at_count(none, ["k"], "s", 3).collect() == []
    assert order_statistics.quantiles(none, ["k"], "s", [0.5]).collect() == []


@pytest.mark.parametrize("whole", [1_000_000, 3])
@pytest.mark.parametrize("down", [True, False])
def test_running_sums(spark, whole, down):
    r = random.Random(8)
    rows = [(k, i, r.randint(0, 9)) for k in ("a", None, "b") for i in r.sample(range(1000), 200)]
    got = {(x["k"], x["i"]): x["upto"] for x in ranking.running_sums(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], "i", {"upto": "v"}, down, whole=whole).collect()}
    assert got == {(k, i): sum(v for q, j, v in rows if q == k and (j >= i if down else j <= i)) for k, i, _ in rows}
