from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice import contracts
from skylattice.operators import audits, calibration, evaluation, generators, graph, search, stats
from skylattice.plans import intervals, joins, ranking, selection, windows


def naive_windows(coverage, quality, exclusions, duration, stride, block, context, dq_bits, injection_bits):
    """Second by second, as the rules say."""
    start, end = max(c[1] for c in coverage), min(c[2] for c in coverage)
    at = {(i, g): (d, n) for i, g, d, n in quality}
    out = {}
    for s in range(math.ceil(start / stride) * stride, end - duration + 1, stride):
        middle = s + duration / 2
        first = start + (s - start) // block * block
        seconds = range(math.floor(middle - context / 2), math.ceil(middle + context / 2))
        if middle - context / 2 < start or middle + context / 2 > end:
            why = windows.REASONS[0]
        elif s + duration > first + block:
            why = windows.REASONS[1]
        elif any(a < s + duration and b > s for a, b in exclusions):
            why = windows.REASONS[2]
        else:
            why = None
            for ifo in sorted(c[0] for c in coverage):
                have = [at.get((ifo, g)) for g in seconds]
                if None in have:
                    why = windows.REASONS[3]
                elif any(d & dq_bits != dq_bits for d, _ in have):
                    why = windows.REASONS[4]
                elif any(n & injection_bits != injection_bits for _, n in have):
                    why = windows.REASONS[5]
                if why:
                    break
        out[s] = (why, f"gps:{first}:{block}")
    return out


@pytest.mark.parametrize("duration,stride,block,context,dq,inj", [(4, 2, 16, 8, 1, 0), (3, 3, 20, 6, 3, 4), (8, 8, 32, 8, 1, 1)])
def test_windows_against_naive(spark, duration, stride, block, context, dq, inj):
    r = random.Random(duration)
    coverage = [("L1", 97, 400), ("H1", 101, 395)]
    quality = [(i, g, r.choice([3, 3, 3, 3, 3, 3, 3, 1, 0] if g % 40 < 8 else [3]), r.choice([7] * 30 + [1])) for i, a, b in coverage for g in range(a, b) if r.random() > 0.004]
    excluded = [(150, 152), (200, 230), (300, 300)]
    df = windows.plan_windows(
        spark, spark.createDataFrame(coverage, "ifo string, gps_start long, gps_end long"), spark.createDataFrame(quality, "ifo string, gps long, dq long, inj long"),
        spark.createDataFrame(excluded, "start long, end long"), duration, stride, block, context, dq, inj,
    )
    got = {x["gps_start"]: (x["reason"], x["gps_block"]) for x in df.collect()}
    want = naive_windows(coverage, quality, excluded[:2], duration, stride, block, context, dq, inj)
    assert got == want and len({w for w, _ in want.values()}) >= 4
    counts = {x["reason"]: x["windows"] for x in windows.rejection_counts(df).collect()}
    assert sum(counts.values()) == len(want) and counts["usable"] == sum(w is None for w, _ in want.values())


def test_windows_need_a_common_interval(spark):
    c = spark.createDataFrame([("H1", 0, 10), ("L1", 20, 30)], "ifo string, gps_start long, gps_end long")
    with pytest.raises(contracts.ContractError):
        windows.plan_windows(spark, c, spark.createDataFrame([], "ifo string, gps long, dq long, inj long"))


def test_running_sums_and_ranks(spark):
    r = random.Random(2)
    rows = list({(r.choice(["a", "b", None]), r.choice([0.0, 1e6]) + r.randint(0, 400) / 7): r.randint(0, 9) for _ in range(900)}.items())
    df = spark.createDataFrame([(*k, v) for k, v in rows], "k string, x double, n long")
    for down in (False, True):
        got = {(x["k"], x["x"]): x["s"] for x in ranking.running_sums(df, ["k"], "x", {"s": "n"}, down, parts=7).collect()}
        for (k, x), _ in rows:
            assert got[(k, x)] == sum(n for (j, y), n in rows if j == k and (y >= x if down else y <= x))
    got = {x["k2"]: x["rank"] for x in ranking.ranked(spark, df.select(F.struct("x", "k").alias("k2")), ["k2"]).collect()}
    assert sorted(got.values()) == list(range(len(rows))) and [k["x"] for k in sorted(got, key=got.get)] == sorted(x for (_, x), _ in rows)
    with pytest.raises(ValueError):
        ranking.with_each(df, spark.range(20), most=10)


def test_a_key_without_background(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0)], "k string, s double")
    got = {x["k"]: x for x in stats.threshold_at_rate(df, ["k"], "s", F.lit(1.0), 1.0, spark.createDataFrame([("a",), ("b",)], "k string")).collect()}
    assert got["a"]["threshold"] == 3.0 and got["b"]["threshold"] == np.finfo(float).max and got["b"]["survivors"] == 0 and got["b"]["ifar"] is None
    assert got["b"]["far_limit"] == pytest.approx(-math.log(0.1))


def test_seed_intervals_go_on_beyond_eleven(spark):
    df = spark.createDataFrame([(n, float(i)) for n in (1, 2, 13, 40) for i in range(n)], "g int, v double")
    got = {x["g"]: x for x in stats.seed_summary(df, ["g"], "v").collect()}
    assert got[1]["low"] is None
    for n, t in ((2, 12.706), (13, 2.131), (40, 2.042)):
        assert got[n]["high"] - got[n]["mean"] == pytest.approx(t * got[n]["deviation"] / math.sqrt(n))


def test_resampled_intervals(spark):
    """Close to numpy's bootstrap, and the same whatever the partitions are."""
    r = np.random.default_rng(1)
    w, hit = r.uniform(0.5, 2, 400), r.random(400) < 0.3
    df = spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(w, hit))], "id long, w double, hit boolean")
    num = F.when(F.col("hit"), F.col("w")).otherwise(0.0)
    a, b = (evaluation.resampled(d, [], "id", num, F.col("w"), 800, 5).first() for d in (df, df.repartition(9)))
    assert a["low"] == pytest.approx(b["low"]) and a["high"] == pytest.approx(b["high"])
    i = r.integers(0, 400, (4000, 400))
    want = np.percentile((w * hit)[i].sum(1) / w[i].sum(1), [2.5, 97.5])
    assert [a["low"], a["high"]] == pytest.approx(want.tolist(), abs=0.01)
    by = evaluation.resampled(df.withColumn("k", F.col("id") % 2), ["k"], "id", num, F.col("w"), 100, 5).collect()
    assert sorted(x["k"] for x in by) == [0, 1]
    out = evaluation.evaluate_search(df.withColumn("s", F.col("w")), df.withColumn("s", num), "s", F.col("w"), 0.4, 10.0, "id", 300, 2).first()
    assert out["boot_low"] < out["weighted_efficiency"] < out["boot_high"] and out["recovered"] == hit.sum()


def brute_cover(rows, want, most, order):
    """All names tried in each round."""
    lack, left, spent, out = {}, {}, 0, []
    for name, label, n, cost, *more in rows:
        lack[label] = want
        left.setdefault(name, (cost, more, {}))[2][label] = n
    while left:
        best = None
        for name, (cost, more, own) in left.items():
            gain = sum(min(n, lack[k]) for k, n in own.items() if lack[k] > 0)
            key = (round(gain / cost, 9), gain, sum(n > 0 and lack[k] > 0 for k, n in own.items()), *more)
            if spent + cost <= most and gain > 0 and (best is None or (key, [-ord(c) for c in name]) > (best[0], [-ord(c) for c in best[1]])):
                best = (key, name)
        if best is None:
            break
        cost, _, own = left.pop(best[1])
        spent += cost
        out.append((len(out), best[1], best[0][1]))
        for k, n in own.items():
            lack[k] = max(0, lack[k] - n)
    return out


def test_greedy_cover_against_brute_force(spark):
    r = random.Random(3)
    names = [f"f{i:02d}" for i in range(14)]
    fixed = {n: (r.randint(1, 4), r.randint(0, 2)) for n in names}
    rows = [(n, label, r.randint(1, 5), *fixed[n]) for n in names for label in "xyz" if r.random() < 0.7]
    df = spark.createDataFrame(rows, "name string, label string, n long, cost int, blocks int")
    got = [tuple(x) for x in graph.greedy_cover(spark, df, 8, 12, ["blocks"]).orderBy("step").collect()]
    assert got == brute_cover(rows, 8, 12, ["blocks"]) and len(got) > 1


def test_restarts_find_a_good_split(spark):
    r = random.Random(4)
    rows = [(f"g{i}", r.randint(1, 9), r.randint(0, 4)) for i in range(9)]
    df = spark.createDataFrame(rows, "group_id string, samples long, class_0 long")
    got = {x["group_id"]: x["split"] for x in graph.restart_split(spark, df, {"train": 0.6, "val": 0.4}, 60, 1).collect()}

    def score(to):
        out = 0.0
        for s, f in (("train", 0.6), ("val", 0.4)):
            for c in (1, 2):
                goal = f * sum(x[c] for x in rows)
                out += ((sum(x[c] for x in rows if to[x[0]] == s) - goal) / max(1.0, goal)) ** 2
        return out

    every = sorted(score(dict(zip([x[0] for x in rows], to))) for to in itertools.product(["train", "val"], repeat=9))
    assert score(got) <= every[25]


def test_quotas_are_exact(spark):
    df = spark.createDataFrame([(f"i{i}",) for i in range(103)], "id string")
    bins = [(4.0, 8.0, 0.40), (8.0, 15.0, 0.35), (15.0, 30.0, 0.20), (30.0, 50.0, 0.05)]
    got = selection.quota_bins(spark, df, "id", bins, 3)
    n = {x["bin"]: x["n"] for x in got.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    assert n == {"4-8": 41, "8-15": 36, "15-30": 21, "30-50": 5}
    assert all(lo <= x["target"] <= hi for x in got.collect() for lo, hi in [tuple(map(float, x["bin"].split("-")))])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, selection.quota_bins(spark, df.repartition(5), "id", bins, 3).collect()))
    with pytest.raises(ValueError):
        selection.quota_bins(spark, df, "id", [(4.0, 8.0, 0.5), (7.0, 9.0, 0.5)], 3)


def test_verified_joins(spark):
    left = spark.createDataFrame([(1, "h1", 2.0), (2, "h2", 3.0)], "id long, sha string, w double")
    right = spark.createDataFrame([(1, "h1", 2.0, "a"), (2, "h2", 3.0 + 1e-13, "b")], "id long, sha string, w double, more string")
    assert sorted(x["more"] for x in joins.verified(left, right, ["id"], ["sha"], ["w"], complete=True).collect()) == ["a", "b"]
    for a, b in ((left, right.withColumn("sha", F.lit("x"))), (left, right.withColumn("w", F.col("w") + 1)), (left, right.where("id = 1")), (left, right.unionByName(right)), (left.where("id = 1"), right)):
        with pytest.raises(contracts.ContractError):
            joins.verified(a, b, ["id"], ["sha"], ["w"], complete=True)


def test_arms_and_runs_must_agree(spark):
    rows = [(a, i, f"w{i}", 1.0 + i, float(i + d)) for a, d in (("H+L", 0), ("H+V", 1), ("L+V", -3), ("H+L+V", 0)) for i in range(5)]
    df = spark.createDataFrame(rows, "arm string, injection_id long, waveform_id string, weight double, score double")
    cut = spark.createDataFrame([(a, 2.0) for a in ("H+L", "H+V", "L+V", "H+L+V")], "arm string, threshold double")
    got = {x["arm"]: x for x in evaluation.subset_arms(df, cut, ["H", "L", "V"], ["H", "L", "V"], 0.05).collect()}
    assert got["H+V"]["relative_delta"] == pytest.approx(14 / 12 - 1) and not got["L+V"]["passed"] and got["H+L"]["complete"]
    assert not evaluation.subset_arms(df.where("arm <> 'H+V'"), cut, ["H", "L", "V"], ["H", "L", "V"], 0.05).first()["complete"]
    with pytest.raises(contracts.ContractError):
        evaluation.subset_arms(df.where("not (arm = 'H+V' and injection_id = 3)"), cut, ["H", "L", "V"], ["H", "L", "V"], 0.05)
    one = df.where("arm = 'H+L'").drop("arm")
    with pytest.raises(contracts.ContractError):
        evaluation.compare_runs(one, one.withColumn("waveform_id", F.lit("x")), ["injection_id"], ["waveform_id"], "score", "weight", "waveform_id", (1.0, 1.0))
    with pytest.raises(contracts.ContractError):
        evaluation.seed_pairs(spark.createDataFrame([("m", "a", 1, 0.1)] * 2, "mode string, arm string, seed int, v double"), ("a", "b"), "v", 1)


def test_audits(spark):
    df = spark.createDataFrame([("g", "train", 1, 0), ("g", "val", 0, 1)], "group_id string, split string, class_0 int, class_1 int")
    with pytest.raises(contracts.ContractError):
        audits.group_audit(df)
    x = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double").withColumn("k", F.lit(0))
    m = audits.moments(x, ["k"], "v").first()
    assert (m["n"], m["total"], m["squares"], m["least"], m["largest"], round(m["nan_share"], 6)) == (3, 4.0, 10.0, 1.0, 3.0, 0.333333)
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "row_id long")
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert audits.evictable(ids(1, 2), ids(2, 1), files, files, "path").count() == 2
    with pytest.raises(contracts.ContractError):
        audits.evictable(ids(1, 2), ids(1), files, files, "path")
    assert [x["row_id"] for x in audits.recovery(ids(1, 2, 3), ids(1, 3), ids(2), "row_id").collect()] == [2]
    for accepted, rejected in ((ids(1, 2), ids(2)), (ids(1), ids(2))):
        with pytest.raises(contracts.ContractError):
            audits.recovery(ids(1, 2, 3), accepted, rejected, "row_id")
    a = spark.createDataFrame([("b1", ["u", "v"]), (None, ["w"])], "block string, urls array<string>")
    b = spark.createDataFrame([("b2", ["v"]), (None, ["x"])], "block string, urls array<string>")
    assert [tuple(x) for x in audits.nested_overlap(a, b, ["block"], F.col("urls")).collect()] == [("url", "v")]
    with pytest.raises(ValueError):
        audits.comparable_overlap(a.select("block"), b.select(F.lit(None).cast("string").alias("block")), ["block", "other"])


def test_rates_need_a_window_of_the_detector(spark):
    w = spark.createDataFrame([("w1", 0, 10, ["H"]), ("w2", 10, 20, ["H", "L"])], "window_id string, gps_start long, gps_end long, ifos array<string>")
    c = spark.createDataFrame([("w1", "H", 5.0), ("w2", "L", 3.0)], "window_id string, ifo string, s double")
    got = {x["ifo"]: x for x in evaluation.detector_rates(w, c, "s", 1.0, 30.0).collect()}
    assert got["H"]["exposure"] == 20 and got["H"]["survivors"] == 1 and got["L"]["survivors"] == 0 and got["L"]["rate_limit"] == pytest.approx(-math.log(0.1) * 3)
    with pytest.raises(contracts.ContractError):
        evaluation.detector_rates(w, c.withColumn("ifo", F.lit("L")), "s", 1.0)
    none = evaluation.detector_rates(w, c.limit(0), "s", 1.0).first()
    assert none["threshold"] == np.finfo(float).max
    with pytest.raises(contracts.ContractError):
        evaluation.merged_background(w.withColumns({"split": F.col("window_id"), "gps_block": F.lit("b"), "observing_run": F.lit("r")}))


def test_catalog_takes_the_last_entry(spark):
    p = spark.createDataFrame([("e1", False), ("e2", True), ("e3", False)], "event string, hit boolean")
    c = spark.createDataFrame([("e1", 5.0), ("e1", 25.0), ("e2", 30.0)], "commonName string, snr double")
    s, misses = evaluation.catalog_hits(p, c, "snr", "hit")
    assert (s.first()["matches"], s.first()["hits"]) == (2, 1) and [x["event"] for x in misses.collect()] == ["e1"]


def test_coverage_of_shifted_slides(spark):
    w = spark.createDataFrame([(str(g), g, g + 8, ["H", "L"]) for g in (0, 8, 24)], "window_id string, gps_start long, gps_end long, ifos array<string>")
    pairs = search.window_pairs(w, search.slide_table(spark, 1, 3, 8), "H", "L")
    assert sorted((x["slide"], x["paired_windows"], x["exposure"]) for x in search.slide_exposure(pairs).collect()) == [(1, 1, 8), (2, 1, 8), (3, 1, 8)]


def test_best_checkpoints(spark):
    m = spark.createDataFrame([(0, 10, 0.5), (1, 20, 0.3), (2, 30, 0.3), (3, 40, None)], "epoch int, step int, v double")
    index = lambda *rows: spark.createDataFrame(rows, "epoch int, step int, path string")
    exact = selection.best_checkpoint(m, index((1, 20, "a.ckpt"), (1, 25, "b.ckpt"), (1, 20, "x/last.ckpt")), "v").first()
    assert (exact["path"], exact["rule"], exact["step"]) == ("a.ckpt", "exact_epoch_and_global_step", 20)
    assert selection.best_checkpoint(m, index((1, 21, "c.ckpt"), (1, 21, "last.ckpt")), "v").first()["rule"] == "unique_checkpoint_for_validation_epoch"
    assert selection.best_checkpoint(m, index((0, 10, "d.ckpt")), "v", largest=True).first()["path"] == "d.ckpt"
    for rows in (((1, 21, "c"), (1, 22, "d")), ((2, 30, "e"),)):
        with pytest.raises(contracts.ContractError):
            selection.best_checkpoint(m, index(*rows), "v")


def test_gaps_to_a_target(spark):
    g = spark.createDataFrame([("a",)] * 3 + [("b",)], "composition string")
    got = {x["composition"]: (x["target"], x["gap"]) for x in selection.composition_gaps(g, 11, {"a": 0.5, "b": 0.25, "c": 0.25}).collect()}
    assert got == {"a": (5, 2), "b": (3, 2), "c": (3, 3)}


def test_banks_and_overlaps(spark):
    w = spark.createDataFrame([("w1", 8, 12, ["H", "L"], "b1"), ("w2", 12, 16, ["H"], "b1"), ("w3", 100, 104, ["H"], "b2")], "window_id string, gps_start long, gps_end long, ifos array<string>, block string")
    s = spark.createDataFrame([("H", 0, [float(i) for i in range(40)]), ("L", 4, [float(-i) for i in range(40)]), ("H", 96, [9.0] * 40)], "ifo string, gps_start long, values array<double>")
    bank = generators.background_bank(w, s, "block", 1, ["gps_start"], 2)
    got = {(x["window_id"], x["ifo"]): x["values"] for x in bank.collect()}
    assert got == {("w1", "H"): [float(i) for i in range(16, 24)], ("w1", "L"): [float(-i) for i in range(8, 16)], ("w3", "H"): [9.0] * 8}
    with pytest.raises(contracts.ContractError):
        generators.background_bank(w, s.where("gps_start < 90"), "block", 1, ["gps_start"], 2)
    sig = spark.createDataFrame([("i1", "H", [1.0] * 8)], "injection_id string, ifo string, values array<double>")
    gl = spark.createDataFrame([("g1", "L", [5.0] * 8)], "glitch_id string, ifo string, values array<double>")
    pairs = spark.createDataFrame([("s", "w1", "i1", "g1")], "scene_id string, window_id string, injection_id string, glitch_id string")
    m = {x["ifo"]: (x["mixture"], x["clean"]) for x in generators.overlap_scenes(bank, sig, gl, pairs).collect()}
    assert m["H"] == ([float(i + 1) for i in range(16, 24)],) * 2 and m["L"] == ([5.0 - i for i in range(8, 16)], [float(-i) for i in range(8, 16)])


def test_overrides_and_ranges(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0], 1, "d1")], "id string, v array<double>, first int, sha string")
    good = spark.createDataFrame([("a", [9.0], "d1")], "id string, v array<double>, sha string")
    assert calibration.override_crop(rows, good, "id", "v", "first", "sha").first()["v"] == [1.0, 9.0, 3.0]
    for bad in (good.withColumn("sha", F.lit("d2")), good.withColumn("id", F.lit("b")), good.unionByName(good)):
        with pytest.raises(contracts.ContractError):
            calibration.override_crop(rows, bad, "id", "v", "first", "sha")
    shard = spark.createDataFrame([("run", "w1", "b1", "val")], "identity string, window_id string, block string, split string")
    with pytest.raises(contracts.ContractError):
        calibration.merge_shards([shard], ["identity"], "window_id", "block", "split", [(0, 5), (4, 6)])


@pytest.mark.parametrize("part", [7.0, 50.0, 1000.0])
def test_keys_in_parts_give_the_same(spark, part):
    r = random.Random(int(part))
    left = spark.createDataFrame([(r.choice("ab"), i, r.uniform(0, 400)) for i in range(150)] + [("c", 900, 5.0), ("a", 901, None)], "k string, id long, t double")
    right = spark.createDataFrame([(r.choice("ab"), i, float(r.randint(20, 380))) for i in range(60)], "k string, v long, s double")
    whole, parts = (sorted(map(tuple, joins.asof_join(left, right, ["k"], "t", "s", ["v"], "v", p).collect()), key=repr) for p in (None, part))
    assert whole == parts
    events = left.where("t is not null").withColumn("score", F.round(F.col("t") % 10))
    chains = [{x["id"]: (x["k"], x["cluster"], x["best"]) for x in intervals.chain_clusters(events, ["k"], "t", "score", 2.5, "id", p).collect()} for p in (None, part)]
    assert chains[0] == chains[1] and len({c[:2] for c in chains[0].values()}) > 10
