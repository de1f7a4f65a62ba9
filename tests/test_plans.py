from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skylattice import contracts
from skylattice.operators import graph, packing, search, stats
from skylattice.plans import intervals, joins, selection


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def naive_union(items):
    total, end = 0, None
    for s, e in sorted(items):
        total += max(0, e - (s if end is None else max(s, end)))
        end = e if end is None else max(end, e)
    return total


@pytest.mark.parametrize("seed", range(3))
def test_interval_union_against_naive(spark, seed):
    r = random.Random(seed)
    items = [(k, s, s + r.randint(0, 30)) for k in "ab" for s in (r.randint(0, 400) for _ in range(60))]
    df = spark.createDataFrame(items, "k string, s long, e long")
    want = {k: naive_union([(s, e) for x, s, e in items if x == k]) for k in "ab"}
    for got in (intervals.interval_union(df, ["k"], "s", "e"), intervals.bucketed_union(df, ["k"], "s", "e", 50)):
        assert {r["k"]: r["union_length"] for r in got.collect()} == want
        assert all(r["intervals"] == 60 for r in got.collect())


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("x", 0, 8), ("x", 8, 16), ("x", 20, 24), ("x", 21, 22), ("x", 24, 28)], "k string, s long, e long")
    r = intervals.interval_union(df, ["k"], "s", "e").first()
    assert (r["union_length"], r["islands"]) == (24, 2)


def test_runs_at_or_above_threshold(spark):
    values = [0.0, 0.1, 0.6, 0.9, 0.2, 0.0, 0.7, 0.0]
    df = spark.createDataFrame([("H1", i, v) for i, v in enumerate(values)], "ifo string, bin int, v double")
    got = intervals.threshold_runs(df, ["ifo"], "bin", "v", 0.5)
    assert rows(got.select("first", "last", "peak")) == [(2, 3, 3), (6, 6, 6)]


def test_chain_compares_with_the_previous_member(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 1.0), (1, "b", 1.0, 5.0), (1, "c", 2.0, 5.0), (1, "d", 3.1, 2.0)], "slide int, id string, t double, score double")
    got = intervals.chain_clusters(df, ["slide"], "t", "score", 1.0, "id")
    assert rows(got.select("cluster", "id", "best")) == [(1, "a", False), (1, "b", True), (1, "c", False), (2, "d", True)]


def test_windows_are_nested_in_blocks(spark):
    df = spark.createDataFrame([(0, 16)], "s long, e long")
    assert rows(intervals.aligned_windows(df, "s", "e", 8, 4).select("window_start")) == [(0,), (4,), (8,)]
    assert rows(intervals.aligned_windows(df, "s", "e", 8, 4, block=8).select("window_start")) == [(0,), (8,)]
    later = spark.createDataFrame([(3, 22)], "s long, e long")  # blocks start with the row
    assert rows(intervals.aligned_windows(later, "s", "e", 4, 2, block=8).select("window_start")) == [(4,), (6,), (12,), (14,)]


def test_contiguous_runs_report_overlap(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 4, 8), ("a", 9, 12), ("a", 11, 14)], "k string, s long, e long")
    assert rows(intervals.contiguous_runs(df, ["k"], "s", "e").select("s", "e", "overlap")) == [(0, 8, 0), (9, 12, 0), (11, 14, 1)]


@pytest.mark.parametrize("seed", range(2))
def test_band_and_nearest_against_naive(spark, seed):
    r = random.Random(seed)
    a = [(i, r.choice("xy"), r.uniform(0, 50)) for i in range(60)]
    b = [(i, r.choice("xy"), r.uniform(0, 50)) for i in range(60)]
    left = spark.createDataFrame(a, "a int, k string, t double")
    right = spark.createDataFrame(b, "b int, k string, u double")
    want = sorted((i, j) for i, k, t in a for j, k2, u in b if k == k2 and abs(t - u) <= 1.5)
    assert rows(joins.band_join(left, right, ["k"], "t", "u", 1.5).select("a", "b")) == want
    best = {i: min((abs(t - u), j) for j, k2, u in b if k == k2)[1] for i, k, t in a if any(k == k2 and abs(t - u) <= 1.5 for _, k2, u in b)}
    assert dict(rows(joins.nearest_within(left, right, ["k"], "a", "t", "u", "b", 1.5).select("a", "b"))) == best


def test_asof_takes_the_last_before_and_keeps_misses(spark):
    left = spark.createDataFrame([(1, "x", 5.0), (2, "x", 0.5), (3, "y", 9.0)], "id int, k string, t double")
    right = spark.createDataFrame([("x", 1.0, 10), ("x", 5.0, 11), ("x", 5.0, 12), ("x", 6.0, 13)], "k string, t double, file int")
    got = joins.asof_join(left, right, ["k"], "t", "t", ["file"], "file")
    assert {r["id"]: r["file"] for r in got.collect()} == {1: 12, 2: None, 3: None}


def test_veto_is_strict(spark):
    df = spark.createDataFrame([(0, 0, 10), (1, 10, 20), (2, 25, 90), (3, 91, 95)], "id int, s long, e long")
    v = spark.createDataFrame([(10, 12), (80, 91)], "vs long, ve long")
    assert rows(joins.without_overlap(df, "s", "e", v, "vs", "ve", 16, "id").select("id")) == [(0,), (3,)]
    odd = spark.createDataFrame([(9, None, 5), (10, 3, None), (11, 4, 4)], df.schema)  # nothing to overlap with
    assert rows(joins.without_overlap(df.unionByName(odd), "s", "e", v, "vs", "ve", 16, "id").select("id")) == [(0,), (3,), (9,), (10,), (11,)]


def test_thresholds(spark):
    df = spark.createDataFrame([("a", s) for s in (9.0, 8.0, 7.0, 1.0)] + [("b", s) for s in (0.1, 0.2, 0.2, 0.3)], "k string, s double")
    got = {r["k"]: r for r in stats.threshold_at_rate(df.where("k = 'a'"), ["k"], "s", F.lit(10.0), 0.2).collect()}["a"]
    assert (got["threshold"], got["survivors"], got["ifar"]) == (8.0, 2, 5.0)
    got = stats.threshold_at_fraction(df.where("k = 'b'"), ["k"], "s", 0.5).first()
    assert (got["threshold"], got["survivors"]) == (0.3, 1)
    none = stats.threshold_at_count(df.where("k = 'a'"), ["k"], "s", 0).first()
    assert none["survivors"] == 0 and 9.0 < none["threshold"] < 9.0 + 1e-12


def test_auroc_and_average_precision(spark):
    df = spark.createDataFrame([("k", 0.1, 0, 1), ("k", 0.4, 0, 2), ("k", 0.4, 1, 3), ("k", 0.8, 1, 4)], "k string, s double, y int, i int")
    assert stats.auroc(df, ["k"], "s", "y").first()["auroc"] == 0.875
    assert stats.average_precision(df, ["k"], "s", "y", "i").first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)


def test_prefix_includes_the_crossing_row(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([3, 1, 4, 1, 5])], "k string, i int, v int")
    assert rows(selection.prefix_to_target(df, ["k"], ["i"], "v", 8).select("i")) == [(0,), (1,), (2,)]


def test_rank_split_rounds_half_to_even(spark):
    df = spark.range(10).withColumn("k", F.lit("a"))
    got = selection.rank_split(df, F.sha2(F.col("id").cast("string"), 256), ["k"], 0.25, 0.25).groupBy("split").count()
    assert dict(rows(got)) == {"val": 2, "test": 2, "train": 6}


def test_hash_split_does_not_depend_on_other_rows(spark):
    from skylattice.functions.columns import hash_uniform, seeded_hash

    split = selection.hash_split(hash_uniform(seeded_hash(1, F.col("id").cast("string"))), ("val", 0.3), ("test", 0.2))
    both = dict(rows(spark.range(40).select("id", split.alias("s"))))
    assert both == dict(rows(spark.range(20).select("id", split.alias("s")))) | dict(rows(spark.range(20, 40).select("id", split.alias("s"))))


def test_shifted_windows_count_exposure_without_candidates(spark):
    scored = [(f"w{i}", i * 8, i * 8 + 8, ["H1", "L1"], {"H1": 3.0, "L1": 2.0}, {"chirp": {"H1": (i * 8 + 4.0,), "L1": (i * 8 + 4.0 + (0.2 if i == 1 else 0),)}}) for i in range(3)]
    t = spark.createDataFrame(scored, "window_id string, gps_start long, gps_end long, valid_ifos array<string>, chirp_scores map<string,double>, peak_times map<string,map<string,struct<gps:double>>>")
    got = search.window_slides(t, search.slide_table(spark, 1, 2, 8), "H1", "L1", band=0.05)
    assert rows(got.groupBy("slide").count()) == [(1, 2), (2, 1)]
    assert got.where("in_band").count() == 2 and got.first()["ranking_score"] == 2.0
    exposure = search.slide_exposure(got.select("slide", "gps_start", "gps_end"))
    assert rows(exposure) == [(1, 2, 16), (2, 1, 8)]
    lacking = t.withColumn("valid_ifos", F.array(F.lit("H1")))
    with pytest.raises(contracts.ContractError):
        search.window_slides(lacking, search.slide_table(spark, 1, 2, 8), "H1", "L1")


def test_block_permutations_keep_the_slot(spark):
    w = spark.createDataFrame([(f"{b}:{s}", b * 256 + s * 8, b * 256 + s * 8 + 8, ["H1", "L1"]) for b in range(3) for s in range(2)], "window_id string, gps_start long, gps_end long, ifos array<string>")
    shifts = spark.createDataFrame([(1,), (2,)], "shift int")
    got = search.block_permutation_pairs(w, shifts, "H1", "L1", F.floor(F.col("gps_start") / 256) * 256)
    assert rows(got.groupBy("shift").agg(F.count("*"), F.sum("duration"))) == [(1, 6, 48), (2, 6, 48)]
    assert search.exposure_schedule(got.groupBy("shift").agg(F.sum("duration").alias("exposure")), "shift", 48).count() == 1


def test_coverage_keeps_misses(spark):
    arrivals = spark.createDataFrame([("i1", "H1", 10.0), ("i1", "L1", 10.0), ("i2", "H1", 20.0), ("i2", "L1", 20.0)], "injection_id string, ifo string, arrival double")
    proposals = spark.createDataFrame([("i1", "H1", 9.9, 10.1), ("i1", "L1", 10.5, 11.0), ("i2", "H1", 20.3, 21.0)], "injection_id string, ifo string, gps_start double, gps_end double")
    got = search.proposal_coverage(arrivals, proposals, 0.6).agg(F.avg((F.col("proposals") > 0).cast("int")), F.avg(F.col("inside").cast("int")), F.avg(F.col("padded").cast("int"))).first()
    assert tuple(got) == (0.75, 0.25, 0.75)


def test_rankings_give_misses_zero(spark):
    inj = spark.createDataFrame([("a", {"H1": 1.0, "L1": 1.01}), ("b", {"H1": 5.0, "L1": 5.0}), ("c", {"H1": 9.0})], "injection_id string, detector_arrival_gps map<string,double>")
    cand = spark.createDataFrame([("1", "a", "H1", 1.0, 4.0), ("2", "a", "L1", 1.005, 3.0), ("3", "a", "L1", 1.3, 9.0), ("4", "b", "H1", 5.0, 7.0)], "candidate_id string, injection_id string, ifo string, gps_peak double, score double")
    got = search.injection_rankings(inj, cand, "H1", "L1", 0.01, 0.001, 0.1)
    assert rows(got.select("injection_id", "ranking_score", "found_pair")) == [("a", 3.0, True), ("b", 0.0, False)]


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(f"r{r.randint(0, 40):02}", f"u{r.randint(0, 60)}") for _ in range(55)]
    parent = {a: a for a, _ in edges}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for a, u in edges:
        if u in seen:
            x, y = sorted((find(a), find(seen[u])))
            parent[y] = x
        seen[u] = a
    want = {a: min(b for b in parent if find(b) == find(a)) for a in parent}
    got = graph.connected_components(spark, spark.createDataFrame(edges, "row string, url string"), "row", "url")
    assert dict(rows(got)) == want


def test_components_of_a_long_chain(spark):
    chain = [1, *range(200, 100, -1)]
    edges = [(x, i + k) for i, x in enumerate(chain) for k in (0, 1)] + [(500, 900)]
    got = dict(rows(graph.connected_components(spark, spark.createDataFrame(edges, "row long, url long"), "row", "url")))
    assert got == {**dict.fromkeys(chain, 1), 500: 500}
    with pytest.raises(RuntimeError):
        graph.connected_components(spark, spark.createDataFrame(edges, "row long, url long"), "row", "url", most=1)


def test_greedy_helpers(spark):
    packed = packing.next_fit(spark, spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "name string, n int"), ["name"], "n", 3)
    assert sorted((x["name"], x["shard"]) for x in packed.collect()) == [("a", 0), ("b", 1), ("c", 1)]


def test_contracts(spark):
    df = spark.createDataFrame([("a", "b1", "train"), ("a", "b1", "val"), ("c", None, "val")], "id string, block string, split string")
    assert rows(contracts.duplicates(df, "id")) == [("a", 2)]
    assert contracts.broken_dependency(df, "block", "split").count() == 1
    assert rows(contracts.shared_values(df.where("split='train'"), df.where("split='val'"), "id", "block")) == [("block", "b1"), ("id", "a")]
    assert rows(contracts.uncontrolled(df, "id", "split")) == [("id", 2), ("split", 2)]
    with pytest.raises(contracts.ContractError):
        contracts.require(contracts.duplicates(df, "id"), "ids repeat")


def test_mahalanobis(spark):
    df = spark.createDataFrame([([0.0], 0), ([2.0], 0), ([8.0], 1), ([10.0], 1)], "v array<double>, y int")
    fit = stats.mahalanobis_fit(df, "v", "y", shrinkage=0.0, epsilon=0.0)
    assert fit["centres"].ravel().tolist() == [1.0, 9.0]
    got = stats.mahalanobis_scores(spark.createDataFrame([([1.0],), ([3.0],), ([9.0],)], "v array<double>"), "v", fit)
    assert [round(r["score"], 6) for r in got.collect()] == [0.0, 2.0, 0.0]


def test_bootstrap_is_the_generator_on_ordered_rows(spark):
    import numpy as np

    x = [float(i % 7) for i in range(40)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "k string, i int, v double").repartition(3)
    got = stats.bootstrap_mean(df, ["k"], "i", "v", replicates=300, seed=9).first()
    rng = np.random.default_rng(9)
    means = np.concatenate([np.array(x)[rng.integers(0, 40, size=(n, 40))].mean(1) for n in (256, 44)])
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
