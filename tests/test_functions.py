from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice import contracts
from skylattice.functions import columns as C
from skylattice.operators import arrays
from skylattice.sources import manifests


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_wilson(spark):
    low, high = C.wilson(F.lit(61), F.lit(83))
    assert round(one(spark, low), 3) == 0.631 and round(one(spark, high), 3) == 0.818
    assert math.isnan(one(spark, C.wilson(F.lit(0), F.lit(0))[0]))


def test_binary_metrics(spark):
    m = {k: one(spark, v) for k, v in C.binary_metrics(*[F.lit(x) for x in (61, 7, 22, 35)]).items()}
    assert m == pytest.approx({"recall": 61 / 83, "precision": 61 / 68, "accuracy": 96 / 125, "f1": 122 / 151})


def test_rank_is_the_second_highest(spark):
    assert one(spark, C.network_rank(F.array(F.lit(3.0), F.lit(9.0), F.lit(5.0)))) == 5.0
    assert one(spark, C.network_rank(F.array(F.lit(3.0), F.lit(None).cast("double")))) == 3.0


def test_touching_intervals_do_not_overlap(spark):
    assert one(spark, C.overlaps(F.lit(0), F.lit(5), F.lit(5), F.lit(9))) is False
    assert one(spark, C.interval_distance(F.lit(1.0), F.lit(3.0), F.lit(4.0))) == 2.0


def test_arrival_gate(spark):
    assert one(spark, C.arrival_gate(F.lit(0.012), F.lit(0.010), F.lit(0.001))) is True
    assert one(spark, C.arrival_gate(F.lit(0.0121), F.lit(0.010), F.lit(0.001))) is False


def test_hashes(spark):
    text = json.dumps({"a": "x", "b": 3}, sort_keys=True, separators=(",", ":"))
    assert one(spark, C.canonical_hash(16, b=F.lit(3), a=F.lit("x"))) == hashlib.sha256(text.encode()).hexdigest()[:16]
    assert one(spark, C.quoted_hash(F.lit("x"))) == hashlib.sha256(b'"x"').hexdigest()
    h = hashlib.sha256(b"7:x").hexdigest()
    assert one(spark, C.hash_uniform(C.seeded_hash(7, F.lit("x")))) == pytest.approx(int(h, 16) / 16**64, abs=1e-12)


def test_half_even_time_key(spark):
    for t in (0.5e-9, 1.5e-9, 2.5e-9, 1.25):
        assert one(spark, C.time_key(F.lit(t))) == round(t * 1e9)


def test_strata_are_half_open(spark):
    for x, want in ((3.9, "<4"), (4.0, "[4,8)"), (8.0, "[8,15)"), (30.0, ">=30")):
        assert one(spark, C.stratum(F.lit(x), [4, 8, 15, 30])) == want


def test_zero_count_limit(spark):
    assert one(spark, C.zero_count_limit(F.lit(10.0))) == pytest.approx(0.2302585093)


def test_last_token_and_prior(spark):
    name = "a" * 32 + "_" + "0123456789ABCDEF" * 2 + "_x.png"
    assert one(spark, C.last_token(F.lit(name))) == ("0123456789abcdef" * 2)
    truth = F.create_map(F.lit("m"), F.lit(5.0))
    assert one(spark, C.outside_prior(truth, {"m": (1, 5), "q": (0, 1)})) == ["q"]


def test_masks(spark):
    a = F.array(*[F.lit(x) for x in (1, 1, 0)])
    b = F.array(*[F.lit(x) for x in (0, 1, 1)])
    assert one(spark, C.mask_iou(a, b)) == pytest.approx(1 / 3)
    zero = F.array(F.lit(0), F.lit(0))
    assert one(spark, C.mask_iou(zero, zero)) == 1.0


def test_parabola(spark):
    assert one(spark, C.parabolic_offset(F.lit(1.0), F.lit(3.0), F.lit(2.0))) == pytest.approx(0.5 * (1 - 2) / (1 - 6 + 2))
    assert one(spark, C.parabolic_offset(F.lit(None).cast("double"), F.lit(3.0), F.lit(2.0))) == 0.0


def test_lag_coherence(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(arrays.lag_coherence(F.col("a"), F.col("b"), 3).alias("x")).first()["x"]
    assert (r["lag"], r["coherence"]) == (1, 1.0)


def test_kernels_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, ref = np.cumsum(rng.normal(size=512)), rng.normal(size=512) * 3 + 7
    df = spark.createDataFrame([(x.tolist(), ref.tolist())], "x array<double>, r array<double>")
    r = df.select(
        arrays.linear_resample(F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: i.cast("double")), F.col("x"), F.array(F.lit(0.5), F.lit(600.0))).alias("lin"),
        arrays.resample_fft(F.col("x"), 512, 256).alias("down"),
        arrays.decimate(F.col("x"), 512, 128).alias("fourth"),
        arrays.decimate(F.col("x"), 512, 512).alias("equal"),
        arrays.pack_half(F.col("x")).alias("half"),
        arrays.whiten(F.col("r"), F.col("r")).alias("own"),
        arrays.whiten(F.col("x"), F.col("r"), component=True).alias("part"),
        arrays.whiten(F.transform("x", lambda v: 2 * v), F.col("r"), component=True).alias("twice"),
        arrays.robust_normalise(F.transform("x", lambda v: v * v)).alias("norm"),
        arrays.mask_filter(F.col("x"), F.array_repeat(F.lit(0.0), 2 * 4 * 5), F.array_repeat(F.lit(0.0), 2 * 4 * 5), (2, 4, 5), 1.0, 64, 16).alias("same"),
        arrays.mask_filter(F.col("x"), F.array_repeat(F.lit(0.7), 2 * 4 * 5), F.array_repeat(F.lit(0.5), 2 * 4 * 5), (2, 4, 5), 0.8, 64, 16).alias("less"),
        arrays.mask_filter(F.col("x"), F.array_repeat(F.lit(1.0), 2 * 4 * 5), F.array_repeat(F.lit(1.0), 2 * 4 * 5), (2, 4, 5), 1.0, 64, 16).alias("kept"),
        arrays.multiresolution_power(F.col("x"), 256, [4.0, 16.0, 64.0], 8, 10, 16.0, 100.0).alias("planes"),
        arrays.comoving_distance(F.lit(0.1)).alias("d"),
    ).first()
    assert r["lin"] == pytest.approx([(x[0] + x[1]) / 2, x[511]]) and len(r["down"]) == 256 and r["equal"] == x.tolist()
    z = np.fft.rfft(x)
    z[np.fft.rfftfreq(512, 1 / 512) >= 57.6] = 0
    assert r["fourth"] == pytest.approx(np.fft.irfft(z)[::4].tolist())
    assert r["half"]["relative_error"] < 1e-3 and np.std(r["own"]) == pytest.approx(1) and r["twice"] == pytest.approx([2 * v for v in r["part"]])
    assert np.median(r["norm"]) == pytest.approx(0, abs=1e-9) and np.allclose(r["same"]["cleaned"], x) and r["same"]["removed"] == 0 and np.allclose(r["kept"]["cleaned"], x) and r["d"] == pytest.approx(433, abs=5)
    assert np.allclose(r["less"]["cleaned"], (1 - 0.8 * 0.35) * x) and r["less"]["mean_gain"] == pytest.approx(0.72) and r["less"]["removed"] == pytest.approx(1 - 0.72**2)
    m = np.zeros((3, 4))
    m[1, 2] = 1
    finer = arrays._hats(3, 5) @ m @ arrays._hats(4, 7).T
    assert finer[2, 4] == pytest.approx(1) and finer[1, 4] == pytest.approx(0.5) and finer[2, 3] == pytest.approx(0.5)
    planes = np.array(r["planes"]).reshape(3, 8, 10)
    for q, plane in zip((4.0, 16.0, 64.0), planes):
        size = max(16, round(min(max(q / 32, 1 / 16), 1) * 256))
        n = 1 << int(np.ceil(np.log2(size)))
        starts = range(0, 512 - size + 1, max(1, (512 - size) // 9))
        power = np.array([np.abs(np.fft.rfft(x[s : s + size] * np.hanning(size), n)) ** 2 for s in starts])
        at = [np.interp(np.linspace(16, 100, 8), np.fft.rfftfreq(n, 1 / 256), p) for p in power]
        want = np.array([np.interp(np.linspace(0, 1, 10), np.linspace(0, 1, len(at)), col) for col in np.array(at).T])
        assert np.allclose(plane, want)


def test_half_precision_has_a_gate(spark):
    df = spark.createDataFrame([([1.0, 1 / 3, 1e-3],)], "x array<double>")
    with pytest.raises(Exception, match="half precision"):
        df.select(arrays.pack_half(F.col("x"), most_error=1e-6)).collect()
    with pytest.raises(Exception, match="half precision"):
        df.select(arrays.pack_half(F.array(F.lit(1.0), F.lit(float("nan"))))).collect()
    zero = spark.createDataFrame([([0.0, 0.0],)], "x array<double>").select(arrays.pack_half(F.col("x")).alias("h")).first()["h"]
    assert (zero["scale"], zero["packed"], zero["overlap"]) == (0.0, [0.0, 0.0], 1.0)
    df = spark.createDataFrame([([1.0, -2.0, 0.5],)], "x array<double>").withColumn("h", arrays.pack_half(F.col("x"))).select(arrays.mixture(F.array(*[F.lit(10.0)] * 3), F.col("h")).alias("m"))
    assert df.first()["m"] == [11.0, 8.0, 10.5]


def test_interval_pairs(spark):
    c = [F.lit(float(v)) for v in (10, 14, 11, 16, 18, 17.5, 0.2, 1.0)]
    s1, e1, p1, s2, e2, p2, x, y = c
    f = spark.range(1).select(*[v.alias(k) for k, v in C.interval_pair(s1, e1, s2, e2, x, y, 1.0, 2.0).items()], C.interval_pair_vector(s1, e1, p1, s2, e2, p2, x, y, 1.0, 2.0).alias("v")).first()
    assert (f["compatible"], f["interval_gap_seconds"], f["center_excess_normalized"], f["width_sum_normalized"]) == (False, 2.0, pytest.approx(4 / 3), 3.0)
    assert f["proposal_logit_sum"] == pytest.approx(np.log(0.25) + np.log((1 - 1e-7) / 1e-7))
    assert f["v"] == pytest.approx([0.2, 1, 0.2, 1, 0.8, 2, 1, 1, 2, 1, 2, 4 / 3, 3.25, 0, 0.25, 0.75])


def test_masks_and_availability(spark):
    assert one(spark, C.relative_mask(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0] and one(spark, C.relative_mask(F.array(F.lit(1.0), F.lit(0.08), F.lit(0.07)))) == [1, 1, 0]
    m = np.array(one(spark, C.weak_mask(F.lit(2.0), F.lit(50.0), F.lit(5.0), 11, 8, 0.0, 100.0, 8.0)))
    t, f = np.linspace(-4, 4, 8, endpoint=False), np.linspace(0, 100, 11)
    assert (m == (np.abs(f - 50) <= 10)[:, None] & (np.abs(t) <= 1)[None, :]).all()
    usable = F.create_map(F.lit("H1"), F.lit(True), F.lit("L1"), F.lit(True), F.lit("V1"), F.lit(False))
    for event, want in (("H1", None), ("V1", "event_ifo_unusable"), ("K1", "event_ifo_unusable")):
        flags, reason = C.detector_availability(usable, ["H1", "L1", "V1"], F.lit(event))
        assert (one(spark, flags), one(spark, reason)) == ([1, 1, 0], want)
    profiles = F.array(F.array(*[F.lit(v) for v in (0.1, 0.9, 0.2)]), F.array(*[F.lit(v) for v in (0.9, 0.3, 0.2)]))
    score, at, peak = C.peak_time(profiles, F.lit(100.0), F.lit(6.0))
    assert (one(spark, score), one(spark, at), one(spark, peak)) == (0.9, 0, 101.0)


def test_polygons_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("0 0.1 0.1 0.2 0.2 0.3 0.1\n\n1 0.1 x 0.2 0.2 0.3 0.1",)], "t string")
    r = manifests.parse_polygons(df, "t").first()
    assert [p["class"] for p in r["polygons"]] == [0] and r["bad_lines"] == [2]
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([("w1", "val"), ("w2", "val"), ("w3", "test")], "window_id string, split string")
    manifests.write_manifest(rows, path)
    back = manifests.read_manifest(spark, path, "window_id string, split string")
    assert manifests.select_split(back, "val").count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        manifests.write_manifest(rows, path, once=True)


def test_reports_arrays_and_masks(spark, tmp_path):
    good = spark.createDataFrame([(1, {"a": [1.0, 2.0]}, (3.0,))], "z int, m map<string,array<double>>, s struct<v:double>")
    manifests.write_report(good, str(tmp_path / "r"))
    assert "".join(p.read_text() for p in (tmp_path / "r").glob("part*")).strip() == '{"m":{"a":[1.0,2.0]},"s":{"v":3.0},"z":1}'
    for bad in ([1, {"a": [1.0, float("nan")]}, (3.0,)], [1, {}, (float("inf"),)]):
        with pytest.raises(contracts.ContractError):
            manifests.write_report(spark.createDataFrame([tuple(bad)], good.schema), str(tmp_path / "x"))
    good.write.parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in manifests.read_arrays(spark, str(tmp_path / "p"), "m").select("z", "name", "samples").collect()] == [(1, "a", [1.0, 2.0])]
    mask = spark.createDataFrame([([0.2, 0.5, 1.0],)], "m array<double>")
    assert manifests.binary_mask(mask, "m").first()["m"] == [0, 1, 1]
    with pytest.raises(contracts.ContractError):
        manifests.binary_mask(mask.select(F.array(F.lit(1.5)).alias("m")), "m")
    for i in (1, 2):
        (tmp_path / f"s{i}.jsonl").write_text('{"id": "w%d"}\n\n' % i)
    manifests.concatenate_shards(spark, [str(tmp_path / "s1.jsonl"), str(tmp_path / "s2.jsonl")], "id string", str(tmp_path / "all"), "id")
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "all")).collect()) == ["w1", "w2"]
    with pytest.raises(contracts.ContractError):
        manifests.concatenate_shards(spark, [str(tmp_path / "s1.jsonl")] * 2, "id string", str(tmp_path / "again"), "id")


def test_quality_defaults_to_all_bits(spark):
    df = spark.createDataFrame([("H1", 100, [1, 3], None)], "ifo string, gps_start long, dqmask array<bigint>, injmask array<bigint>")
    assert [tuple(r) for r in manifests.quality_seconds(df).orderBy("gps").collect()] == [("H1", 100, 1, -1), ("H1", 101, 3, -1)]


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    from skylattice.streaming import ingest

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, k string").write.parquet(src)
    split = F.when(F.col("id") % 2 == 0, "val").otherwise("train")
    run = lambda: ingest.ingest_shards(spark.readStream.schema("id long, k string").parquet(src).withColumn("t", F.timestamp_seconds(F.lit(1_700_000_000))), out, ck, "id", split, "1 day", "t").awaitTermination(120)
    for _ in range(2):
        run()
        spark.createDataFrame([(2, "b"), (3, "c")], "id long, k string").write.mode("append").parquet(src)
    run()
    assert sorted((r["id"], r["split"]) for r in spark.read.parquet(out).collect()) == [(1, "train"), (2, "val"), (3, "train")]


def test_stream_sessions_and_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    from skylattice.streaming import ingest

    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(seconds=s), float(s)) for s in (0, 10, 21, 40)]
    src = str(tmp_path / "s")
    spark.createDataFrame(rows, "k string, ts timestamp, value double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp, value double").parquet(src)
    for name, df, want in (
        ("s", ingest.sessions(stream, "ts", "10 seconds", "1 hour", "k"), [1, 1, 2]),
        ("w", ingest.windowed_counts(stream, "ts", "20 seconds", "20 seconds", "1 hour"), [1, 1, 2]),
    ):
        q = df.writeStream.format("memory").queryName(f"t_{name}").outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r["n"] for r in spark.table(f"t_{name}").collect()) == want


def test_kernels_take_rows_of_any_length_and_nulls(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if n is None else rng.normal(size=n).tolist()) for i, n in enumerate([300, None, 77, 300, 40])]
    df = spark.createDataFrame(rows, "i int, x array<double>").coalesce(1)
    none = F.array_repeat(F.lit(0.0), 6)
    got = df.select("i", "x", arrays.whiten("x", "x").alias("w"), arrays.mask_filter(F.col("x"), none, none, (1, 2, 3), 1.0, 64, 20).alias("m")).collect()
    for r in got:
        if r["x"] is None:
            assert r["w"] is None and r["m"]["cleaned"] is None and r["m"]["removed"] is None
        else:
            alone = arrays.whitened(np.array([r["x"]]), np.array([r["x"]]))[0]
            assert np.allclose(r["w"], alone) and np.std(r["w"]) == pytest.approx(1) and np.allclose(r["m"]["cleaned"], r["x"])
