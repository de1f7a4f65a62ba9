from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice import contracts
from skylattice.operators import calibration, generators


CANDIDATE = "timing_method string, injection_id string, ifo string, candidate_id string, gps_peak double, timing_resolution_seconds double"


def test_calibration_takes_absolute_errors_of_the_best_candidates(spark):
    arrivals = spark.createDataFrame([(f"i{n}", "H1", 100.0 * n) for n in range(12)], "injection_id string, ifo string, arrival double")
    errors = [0.001 * (n + 1) * (-1) ** n for n in range(11)]
    rows = [("m", f"i{n}", "H1", f"c{n}", 100.0 * n + e, 0.004) for n, e in enumerate(errors)]
    rows += [("m", "i0", "H1", "far", 0.3, 0.9), ("m", "i11", "H1", "beyond", 1100.6, 0.001), ("few", "i1", "H1", "f", 100.0, 0.02), ("m", "i3", "L1", "x", 300.0, 0.5)]
    cand = spark.createDataFrame(rows, CANDIDATE)
    cal = calibration.timing_calibration(cand, arrivals, 0.5, quantile=0.9, least=10, most_uncertainty=0.0101)
    by = {r["timing_method"]: r for r in cal.collect()}
    want = np.quantile(np.abs(errors), [0, 0.5, 0.9, 1])
    m = by["m"]
    assert (m["matches"], m["eligible"], m["maximum_resolution_seconds"], m["calibration_gate_passed"]) == (11, 12, 0.004, True)
    assert [m[k] for k in ("error_least", "error_median", "empirical_timing_uncertainty_seconds", "error_largest")] == pytest.approx(want.tolist(), abs=1e-9)
    assert by["few"]["gates"] == {"matches": False, "resolution": False, "uncertainty": True} and not by["few"]["calibration_gate_passed"]
    some = cand.where("timing_resolution_seconds <= 0.004 or timing_method = 'few'")
    got = {x["candidate_id"]: x for x in calibration.apply_calibration(some, cal).collect()}
    assert got["c3"]["timing_empirically_calibrated"] and got["c3"]["gps_peak"] == rows[3][4] and got["c3"]["empirical_timing_uncertainty_seconds"] == pytest.approx(want[2])
    assert not got["f"]["timing_empirically_calibrated"] and got["f"]["empirical_timing_uncertainty_seconds"] is None
    assert not any(x["timing_empirically_calibrated"] for x in calibration.apply_calibration(some, cal, same_provenance=False).collect())
    with pytest.raises(contracts.ContractError):
        calibration.apply_calibration(cand, cal)


def test_consensus_of_an_odd_panel(spark):
    rows = [("t", "a", [1, 1, 0]), ("t", "b", [0, 1, 0]), ("t", "c", [0, 1, 1]), ("even", "a", [1, 0, 0]), ("even", "b", [1, 0, 0])]
    got = calibration.annotation_consensus(spark.createDataFrame(rows, "task string, who string, mask array<int>"), "task", "who", "mask", 2).collect()
    assert [(r["task"], r["majority"], round(r["mean_iou"], 6)) for r in got] == [("t", [0, 1, 0], round((0.5 + 1 / 3 + 0.5) / 3, 6))]


def test_overrides_replace_the_crop_only(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0], 1), ("b", [5.0, 6.0], 0)], "id string, v array<double>, first int")
    over = spark.createDataFrame([("a", [9.0, 8.0])], "id string, v array<double>")
    got = {r["id"]: r["v"] for r in calibration.override_crop(rows, over, "id", "v", "first").collect()}
    assert got == {"a": [1.0, 9.0, 8.0, 4.0], "b": [5.0, 6.0]}


def test_conditions_must_be_complete(spark):
    df = spark.createDataFrame([("a", "raw", 1.0), ("a", "cleaned", 2.0)], "id string, c string, v double")
    assert tuple(calibration.conditions_side_by_side(df, ["id"], "c", ["raw", "cleaned"], "v").first()) == ("a", 1.0, 2.0)
    with pytest.raises(contracts.ContractError):
        calibration.conditions_side_by_side(df, ["id"], "c", ["raw", "other"], "v")


def test_conditions_across_backends(spark):
    rows = [(b, i, c, 1.0) for b in ("x", "y") for i in (1, 2) for c in ("clean", "raw")]
    df = spark.createDataFrame(rows, "backend string, id int, c string, v double")
    assert calibration.conditions_side_by_side(df, ["backend", "id"], "c", ["clean", "raw"], "v", "backend").count() == 4
    for bad in (df.where("not (backend = 'y' and id = 2)"), df.unionByName(df.limit(1))):
        with pytest.raises(contracts.ContractError):
            calibration.conditions_side_by_side(bad, ["backend", "id"], "c", ["clean", "raw"], "v", "backend")


def test_models_load_once_a_task_and_may_return_many_rows(spark):
    def load():
        return lambda pdf: pd.DataFrame({"id": [x for x in pdf["id"] for _ in range(x)]})

    assert sorted(r["id"] for r in calibration.score_rows(spark.range(3), load, "id long").collect()) == [1, 2, 2]


def test_shards_merge_under_one_identity(spark):
    one = spark.createDataFrame([("run", "w1", "b1", "val")], "identity string, window_id string, block string, split string")
    two = spark.createDataFrame([("run", "w2", "b1", "val")], one.schema)
    assert calibration.merge_shards([one, two], ["identity"], "window_id", "block", "split").count() == 2
    with pytest.raises(contracts.ContractError):
        calibration.merge_shards([one, two.withColumn("split", F.lit("test"))], ["identity"], "window_id", "block", "split")


def test_generators_are_deterministic(spark):
    a = generators.scene_recipes(spark, "train", 400, {"noise": 0.25, "chirp": 0.5, "chirp+glitch": 0.25}, ["H1", "L1"], 7)
    n = {r["scene_type"]: r["count"] for r in a.groupBy("scene_type").count().collect()}
    assert abs(n["chirp"] - 200) < 40 and a.where("scene_type = 'noise' and target_snr is not null").count() == 0
    assert a.select("scene_id").distinct().count() == 400 and sorted(a.collect()) == sorted(a.repartition(3).collect())
    w = spark.createDataFrame([("val", f"w{i}") for i in range(3)] + [("test", "x")], "split string, window_id string")
    inj = generators.injection_population(w, {"val": 7, "test": 2}, {"val": 1.0, "test": 0.5}, 10.0, 2.0, 1, spark)
    assert {(r["split"], r["window_id"]): r["count"] for r in inj.groupBy("split", "window_id").count().collect()}[("test", "x")] == 2
    assert sorted(r["count"] for r in inj.where("split = 'val'").groupBy("window_id").count().collect()) == [2, 2, 3]
