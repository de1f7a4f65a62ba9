from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skylattice import contracts
from skylattice.functions import columns as C
from skylattice.operators import arrays, audits, calibration, search
from skylattice.plans import ranking, selection
from skylattice.sources import manifests as M
from skylattice.streaming import ingest


def test_bad_lines_have_their_numbers_in_files_of_many_blocks(spark, tmp_path):
    bad = {}
    for f in ("a.json", "b.json"):
        lines = []
        for i in range(1, 4001):
            if i % 977 == 5:
                lines.append('{"x": ')
                bad[(f, i)] = lines[-1]
            else:
                lines.append("" if i % 50 == 0 else json.dumps({"x": i, "pad": "é" * 40}))
        (tmp_path / f).write_text("\n".join(lines) + "\n", encoding="utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = M.read_manifest_errors(spark, str(tmp_path), "x long, pad string")
        assert {(r["file"].rsplit("/", 1)[1], r["line"]): r["text"] for r in found.collect()} == bad
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_checked_rows(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"id": "a", "x": 1.0}\n\n{"id": "b", "x": -1.0}\n')
    with pytest.raises(contracts.ContractError, match="positive"):
        M.read_checked(spark, str(tmp_path / "m.json"), "id string, x double", positive=F.col("x") > 0)
    assert M.read_checked(spark, str(tmp_path / "m.json"), "id string, x double", there=F.col("id").isNotNull() & contracts.finite("x")).count() == 2


def test_csv_goes_round(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.5), ("a", None), ("c", 1.0)], "id string, x double")
    M.write_csv(df, str(tmp_path / "c"), "id")
    back = M.read_csv(spark, str(tmp_path / "c"), "id string, x double", ("id",))
    assert sorted(tuple(r) for r in back.collect()) == [("a", None), ("b", 2.5), ("c", 1.0)]
    with pytest.raises(contracts.ContractError, match="missing"):
        M.read_csv(spark, str(tmp_path / "c"), "id string, x double", ("label",))


def test_split_layout(spark, tmp_path):
    M.write_split_layout(spark.createDataFrame([(1, "train"), (2, "val"), (3, "train")], "i int, split string"), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=train", "split=val"]
    assert spark.read.parquet(str(tmp_path / "s" / "split=train")).count() == 2


def test_labelled_images(spark, tmp_path):
    images, labels = tmp_path / "images", tmp_path / "labels"
    images.mkdir(), labels.mkdir()
    for stem in ("one", "two"):
        (images / f"{stem}.png").write_bytes(stem.encode())
        (labels / f"{stem}.txt").write_text("0 0 0 1 0 1 1\n\n1 0 0 2\n")
    got = {r["sample_id"]: r for r in M.read_labelled_images(spark, str(images), str(labels)).collect()}
    assert got["one"]["image_bytes"] == 3 and got["two"]["polygons"][0]["points"] == [0, 0, 1, 0, 1, 1] and list(got["one"]["bad_lines"]) == [2]
    (images / "three.png").write_bytes(b"3")
    (labels / "three.txt").write_text("")
    got = {r["sample_id"]: r for r in M.read_labelled_images(spark, str(images), str(labels)).collect()}
    assert len(got) == 3 and got["three"]["polygons"] == [] and got["three"]["label_sha256"] == hashlib.sha256(b"").hexdigest()
    (labels / "four.txt").write_text("")
    with pytest.raises(contracts.ContractError, match="alone"):
        M.read_labelled_images(spark, str(images), str(labels))


def test_segments_that_a_series_holds_whole(spark):
    df = spark.createDataFrame([("a", 100.0, 4.0, [float(i) for i in range(40)]), ("b", 104.0, 4.0, [0.0] * 8)], "k string, t double, rate double, v array<double>")
    got = M.series_segment(df, "t", "rate", "v", 104.0, 2.0).collect()
    assert [(r["k"], r["t"], r["v"]) for r in got] == [("a", 103.0, [12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 18.0, 19.0])]


def test_small_columns(spark):
    df = spark.createDataFrame([(9.0, 10.0, "gps:64:32", "a" * 64, [1.0, 2.0], [2.0, 2.0], "Blip", 0.9, {"L1": 0.5}, [2, 9])], "t double, c double, b string, h string, x array<double>, y array<double>, label string, conf double, m map<string,double>, bins array<int>")
    start, length = C.parse_block(F.col("b"))
    values, there = C.ordered_values(F.col("m"), ["H1", "L1"])
    r = df.select(
        C.contains_half_open(F.col("t"), F.col("c"), 2.0).alias("from"), C.contains_half_open(F.lit(11.0), F.col("c"), 2.0).alias("to"), start.alias("start"), length.alias("length"),
        C.block_label(F.lit(64.0), 32).alias("block"), C.is_sha256(F.col("h")).alias("hex"), C.is_sha256(F.lit("A" * 64)).alias("upper"), C.is_sha256(F.lit(None).cast("string")).alias("none"),
        C.timing_gate(F.lit(0.01), F.lit(0.01), F.lit(0)).alias("gate"), C.timing_gate(F.lit(0.01), F.lit(0.01), F.lit(1)).alias("missed"),
        C.mean_squared_error(F.col("x"), F.col("y")).alias("mse"), C.dot(F.col("x"), F.col("y")).alias("dot"), C.retention(F.col("x"), F.col("y"), F.array(F.lit(1.0), F.lit(0.0))).alias("kept"),
        C.known_label(F.col("label"), F.col("conf"), ["None_of_the_Above"], 0.9).alias("known"), C.known_label(F.lit(None).cast("string"), F.col("conf"), ["x"], 0.9).alias("unknown"),
        values.alias("values"), there.alias("there"), C.dilated_bins(F.col("bins"), 1, 9).alias("wide"), C.first_contained(F.lit("A_bbH_blip"), ["bbh", "blip"]).alias("first"),
        C.rescale_below(F.lit(2.0), F.lit(0.5), 4.0, 16.0).alias("drawn"), C.rescale_below(F.lit(5.0), F.lit(0.5), 4.0, 16.0).alias("left"),
        C.all_bits(F.array(F.lit(3), F.lit(7)), 3).alias("bits"), C.ratio_or_nan(F.lit(1), F.lit(0)).alias("nan"),
    ).first()
    assert r["from"] and not r["to"] and (r["start"], r["length"], r["block"]) == (64, 32, "gps:64:32") and r["hex"] and not r["upper"] and not r["none"]
    assert r["gate"] and not r["missed"] and r["mse"] == 0.5 and r["dot"] == 6 and r["kept"] == pytest.approx(1.0) and r["known"] and not r["unknown"]
    assert r["values"] == [0.0, 0.5] and r["there"] == [False, True] and r["wide"] == [0, 1, 1, 1, 0, 0, 0, 0, 1] and r["first"] == "bbh"
    assert r["drawn"] == pytest.approx(8) and r["left"] == 5 and r["bits"] and r["nan"] != r["nan"]


def test_half_precision_goes_round(spark):
    df = spark.createDataFrame([([0.0, 1e-21, -4e-21],), ([0.0],)], "x array<double>")
    got = df.select("x", arrays.pack_half(F.col("x")).alias("p")).select("x", arrays.unpack_half(F.col("p")).alias("y")).collect()
    assert all(r["y"] == pytest.approx(r["x"], rel=1e-3) for r in got)


def test_masks_of_the_own_detector(spark):
    df = spark.createDataFrame([("L1", 1.0), (None, 1.0), ("L1", None)], "ifo string, d double")
    mask = C.weak_masks(F.col("d"), F.lit(20.0), F.lit(4.0), F.col("ifo"), ["H1", "L1"], [4.0, 16.0, 64.0], 5, 8, 10.0, 50.0, 8.0)
    own, none, unknown = [r["m"] for r in df.select(mask.alias("m")).collect()]
    plane = df.limit(1).select(C.weak_mask(F.col("d"), F.lit(20.0), F.lit(4.0), 5, 8, 10.0, 50.0, 8.0).alias("p")).first()["p"]
    zero = [[0] * 8] * 5
    assert own == [[zero] * 3, [plane] * 3] and plane != zero and none == [[zero] * 3] * 2 and unknown is None


def test_choices_and_deficits(spark):
    df = spark.createDataFrame([("a", 0.2, False), ("b", 0.9, None), ("c", 0.5, True), ("d", 0.4, True)], "k string, s double, ok boolean")
    assert selection.first_passing(df, ["k"], F.col("ok"), "s").first()["k"] == "c"
    assert selection.first_passing(df.where("not coalesce(ok, false)"), ["k"], F.col("ok"), "s").first()["k"] == "b"
    rows = spark.createDataFrame([("x",), ("x",), ("x",), ("y",), (None,)], "label string")
    got = sorted(tuple(r) for r in selection.label_deficits(rows, "label", 2, ["y", "z"]).collect())
    assert got == [("x", 3, 0), ("y", 1, 1), ("z", 0, 2)]


def test_places_in_keys_by_ranges_equal_those_by_windows(spark):
    df = spark.createDataFrame([(k, i * 7 % 31) for i in range(60) for k in ("a", None, "b")[: 1 + i % 3]], "k string, v int").withColumn("id", F.monotonically_increasing_id())
    rows = lambda d: sorted((tuple(r) for r in d.select("k", "v", "id", "at", "n").collect()), key=repr)
    assert rows(ranking.numbered(df, ["k"], ["v", "id"], "at", "n", whole=5)) == rows(ranking.numbered(df, ["k"], ["v", "id"], "at", "n"))


def test_pairs_share_their_provenance(spark):
    injections = spark.createDataFrame([("i", {"H1": 10.0, "L1": 10.0})], "injection_id string, detector_arrival_gps map<string,double>")
    rows = [("i", "H1", "h", 10.0, 5.0, "m1"), ("i", "L1", "l1", 10.0, 9.0, "m2"), ("i", "L1", "l2", 10.0, 3.0, "m1")]
    candidates = spark.createDataFrame(rows, "injection_id string, ifo string, candidate_id string, gps_peak double, score double, model string")
    best = lambda *p: search.injection_rankings(injections, candidates, "H1", "L1", 0.01, 0.001, 0.1, p).first()["c2"]
    assert best() == "l1" and best("model") == "l2"


def test_detector_sets_of_shards(spark):
    schema = "id string, block string, split string, model string, ifo string, ifos array<string>"
    good = spark.createDataFrame([("a", "b1", "train", "m", "H1", ["H1", "L1"])], schema)
    merge = lambda *rows: calibration.merge_shards([good, spark.createDataFrame(rows, schema)], ["model"], "id", "block", "split", detectors=("ifo", "ifos"))
    assert merge(("c", "b2", "val", "m", "L1", ["V1", "L1"])).count() == 2
    for ifo, ifos in (("V1", ["H1", "L1"]), ("H1", ["H1", "H1"]), ("H1", ["H1"]), ("H1", ["H1", None]), ("H1", None)):
        with pytest.raises(contracts.ContractError, match="detectors"):
            merge(("c", "b2", "val", "m", ifo, ifos))


def test_an_intent_comes_before_eviction(spark, tmp_path):
    ids = spark.createDataFrame([("1",), ("2",)], "row_id string")
    files = lambda *f: spark.createDataFrame([(x,) for x in f], "file string")
    go = lambda *f: audits.eviction_intent(ids, ids, files(*f), files(*f), "file", str(tmp_path / "intent"))
    assert go("a", "b").count() == 2 and spark.read.json(str(tmp_path / "intent")).count() == 2
    assert go("b", "a").count() == 2
    with pytest.raises(contracts.ContractError, match="intent"):
        go("a", "c")


def test_vetoes_of_a_stream(spark, tmp_path):
    rows = [(1, "2020-01-01 23:59:00"), (2, "2020-01-02 00:01:00"), (3, "2020-01-02 00:10:00"), (4, None)]
    spark.createDataFrame(rows, "i int, t string").select("i", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    vetoes = spark.createDataFrame([("2020-01-01 23:58:00", "2020-01-02 00:10:00")], "s string, e string").select(F.to_timestamp("s").alias("start"), F.to_timestamp("e").alias("end"))
    stream = spark.readStream.schema("i int, t timestamp").parquet(str(tmp_path / "in"))
    query = ingest.without_vetoes(stream, "t", vetoes).writeStream.format("memory").queryName("kept_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["i"] for r in spark.table("kept_rows").collect()) == [3, 4]
