"""Totals of clustered slides: equal to those of the listed pairs, and no row for each pair on the way."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skylattice import queries
from skylattice.operators import search

CANDIDATES = "window_id bigint, candidate_id string, gps_peak bigint, score double, ifo string"
PAIRS = "slide int, offset bigint, a_window bigint, b_window bigint"


def rows(df):
    return sorted((x.slide, x.pairs, x.clusters, repr(None if x.total is None else round(x.total, 9))) for x in df.select("slide", "pairs", "clusters", "total").collect())


@pytest.mark.parametrize("band, gap", [(0, 0), (1, 3), (5, 1), (20, 10)])
def test_totals_equal_those_of_the_listed_pairs(spark, band, gap):
    r = random.Random(band)
    scores = [None, None, float("nan"), float("inf"), -1.0, 0.0, 1.5, 2.0, 3.25]
    found = [(w, f"c{i}", r.choice([None, *range(-40, 40)]), r.choice(scores), r.choice("ABC")) for i, w in enumerate(r.choices([*range(4), None], k=200))]
    slides = [(s, o, r.randint(0, 4), r.randint(0, 4)) for s, o in enumerate((0, 7, -11, 1000), 1) for _ in range(4)]
    candidates, pairs = spark.createDataFrame(found, CANDIDATES), spark.createDataFrame(slides, PAIRS)
    listed = search.slide_coincidences(pairs, candidates, "A", "B", band, gap)
    want = rows(listed.groupBy("slide").agg(F.count("*").alias("pairs"), F.count_if("best").alias("clusters"), F.sum(F.when(F.col("best"), F.col("ranking_score"))).alias("total")))
    assert len(want) == 3 and rows(search.slide_totals(pairs, candidates, "A", "B", band, gap)) == want


def test_totals_need_whole_numbers(spark):
    candidates, pairs = spark.createDataFrame([], CANDIDATES), spark.createDataFrame([], PAIRS)
    assert rows(search.slide_totals(pairs, candidates, "A", "B", 1, 1)) == []
    for c, p, band in ((candidates.withColumn("gps_peak", F.lit(1.5)), pairs, 1), (candidates, pairs.withColumn("offset", F.lit(1.5)), 1), (candidates, pairs, 0.5), (candidates, pairs, -1)):
        with pytest.raises(ValueError, match="whole numbers"):
            search.slide_totals(p, c, "A", "B", band, 1)


def test_dense_windows_make_no_row_for_each_pair(spark, tmp_path):
    """Three hours with 200 candidates of each detector within a second: 120,000 pairs."""
    start = dt.datetime(2024, 1, 1)
    events = [(h * 400 + 2 * i + v, start + dt.timedelta(hours=h, milliseconds=5 * i + v), kind, float(i)) for h in range(3) for i in range(200) for v, kind in enumerate(("purchase", "view"))]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, event_type string, value double").withColumn("user_id", F.lit(1)).write.parquet(f"{tmp_path}/events.parquet")
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    got = sorted(map(tuple, queries.QUERIES["slide_coincidence_clusters"](spark, str(tmp_path)).collect()))
    assert got == [(1, 2, 80_000, 2, 398.0), (2, 1, 40_000, 1, 199.0)]
    assert sum(n for s, n in stages().items() if s not in before) < 12_000
