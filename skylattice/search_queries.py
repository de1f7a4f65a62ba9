"""Queries over the driver's tables for planning, evaluation, audits and selection; registered with those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice import contracts
from skylattice.functions import columns as C
from skylattice.operators import audits, calibration, evaluation, exposure, graph, matching, packing, profiles, resampling, search, stats
from skylattice.plans import intervals, joins, selection, windows
from skylattice.queries import DAY, EV, HOUR, MICRO, _events, _t, _w, query


def _quality(spark, sf):
    """Hours stand in for seconds: an hour of a detector has bit 1, and bit 2 from two events on."""
    e = _events(spark, sf).where(F.col("event_type").isin("purchase", "view")).groupBy(F.col("event_type").alias("ifo"), F.floor(F.col("us") / (HOUR * MICRO)).alias("gps")).agg(F.count("*").alias("n"))
    quality = e.select("ifo", "gps", F.when(F.col("n") >= 2, 3).otherwise(1).cast("bigint").alias("dq"), F.lit(-1).cast("bigint").alias("inj"))
    coverage = e.groupBy("ifo").agg(F.min("gps").alias("gps_start"), (F.max("gps") + 1).alias("gps_end"))
    bad = _events(spark, sf).where("event_type = 'error' and value >= 40").select(F.floor(F.col("us") / (HOUR * MICRO)).alias("start"))
    return coverage, quality, bad.withColumn("end", F.col("start") + 1)


PLAN = f"""WITH {EV}, q AS (SELECT event_type AS ifo, us // 3600000000 AS gps, CASE WHEN count(*) >= 2 THEN 3 ELSE 1 END AS dq FROM ev WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2),
c AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT ifo, min(gps) AS a, max(gps) + 1 AS b FROM q GROUP BY 1)),
g AS (SELECT a, b, unnest(generate_series((ceil(a / 2) * 2)::BIGINT, b - 4, 2)) AS s FROM c),
x AS (SELECT us // 3600000000 AS s, us // 3600000000 + 1 AS e FROM ev WHERE event_type = 'error' AND value >= 40),
w AS (SELECT s, ifo, count(gps) AS n, bit_and(dq) AS dq FROM g CROSS JOIN (SELECT DISTINCT ifo FROM q) LEFT JOIN q USING (ifo) WHERE gps IS NULL OR (gps >= s - 2 AND gps < s + 6) GROUP BY 1, 2),
d AS (SELECT g.s, i.ifo, coalesce(w.n, 0) AS n, w.dq FROM g CROSS JOIN (SELECT DISTINCT ifo FROM q) i LEFT JOIN w ON w.s = g.s AND w.ifo = i.ifo),
b AS (SELECT s, arg_min(CASE WHEN n <> 8 THEN 'incomplete_quality_context' ELSE 'required_dq_bits_missing_in_context' END, ifo) FILTER (WHERE n <> 8 OR dq & 1 <> 1) AS bad, bit_and(dq) AS dq_and FROM d GROUP BY 1),
r AS (SELECT g.s, dq_and, a + (g.s - a) // 24 * 24 AS block, CASE WHEN g.s - 2 < a OR g.s + 6 > b THEN 'insufficient_preprocessing_context' WHEN g.s + 4 > a + (g.s - a) // 24 * 24 + 24 THEN 'crosses_gps_block_boundary'
  WHEN EXISTS (SELECT 1 FROM x WHERE x.s < g.s + 4 AND x.e > g.s) THEN 'catalog_or_declared_exclusion' ELSE bad END AS reason FROM g JOIN b USING (s))"""


def _plan(spark, sf):
    coverage, quality, bad = _quality(spark, sf)
    return windows.plan_windows(spark, coverage, quality, bad, duration=4, stride=2, block=24, context=8, dq_bits=1)


@query(f"""{PLAN} SELECT s AS gps_start, s + 4 AS gps_end, 'gps:' || block || ':24' AS gps_block, dq_and, reason, 'background-' || substr(sha256('{{"gps":' || s || ',"ifos":["purchase","view"]}}'), 1, 20) AS window_id FROM r""")
def background_windows(spark, sf):
    """Windows of four hours every two, in blocks of a day from the common start on, with eight hours of context."""
    return _plan(spark, sf).select("gps_start", "gps_end", "gps_block", "dq_and", "reason", "window_id")


@query(f"""{PLAN} SELECT coalesce(reason, 'usable') AS reason, count(*) AS windows FROM r GROUP BY 1""")
def background_rejections(spark, sf):
    return windows.rejection_counts(_plan(spark, sf))


LINES = """l AS (SELECT l_orderkey AS parent, CASE WHEN l_linenumber % 2 = 1 THEN 'H' ELSE 'L' END AS ifo, l_linenumber, l_partkey % 50 + l_linenumber / 10.0 AS s, l_partkey % 50 + l_linenumber / 10.0 + 1 + l_quantity / 10 AS e, l_discount * 10 AS score FROM lineitem WHERE l_linenumber <= 4)"""


def _intervals(spark, sf):
    n = F.col("l_linenumber")
    start = F.col("l_partkey") % 50 + n / 10.0
    return _t(spark, sf, "lineitem").where(n <= 4).select(F.col("l_orderkey").alias("parent"), F.when(n % 2 == 1, "H").otherwise("L").alias("ifo"), n.alias("line"), start.alias("gps_start"), (start + 1 + F.col("l_quantity") / 10).alias("gps_end"), (F.col("l_discount") * 10).alias("score"))


@query(f"""WITH {LINES}, p AS (SELECT a.parent, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, a.score AS x, b.score AS y, greatest(0, a.s - b.e, b.s - a.e) AS gap, (a.e - a.s) + (b.e - b.s) AS w FROM l a JOIN l b ON a.parent = b.parent AND a.ifo = 'H' AND b.ifo = 'L')
SELECT count(*) AS pairs, round(sum(gap), 4) AS gaps, round(sum(greatest(0, abs((s1 + e1) / 2 - (s2 + e2) / 2) - 3) / greatest(w / 2, 2)), 4) AS excess, round(sum(w / 2), 4) AS widths,
  round(sum(ln(greatest(1e-7, least(1 - 1e-7, x)) / (1 - greatest(1e-7, least(1 - 1e-7, x)))) + ln(greatest(1e-7, least(1 - 1e-7, y)) / (1 - greatest(1e-7, least(1 - 1e-7, y))))), 3) AS logits,
  round(sum(greatest(0, least(e1, e2) - greatest(s1, s2)) / 2), 3) AS overlaps, round(sum(abs(x - y)), 4) AS score_gaps FROM p WHERE gap <= 3""")
def interval_pair_features(spark, sf):
    """Pairs of two detectors within a parent, no further apart than the limit, and their features."""
    p = joins.pairs_within(_intervals(spark, sf), "parent", "ifo", "H", "L", 3.0)
    c = [F.col(x) for x in ("a_gps_start", "a_gps_end", "b_gps_start", "b_gps_end", "a_score", "b_score")]
    f = C.interval_pair(*c, 3.0, 2.0)
    v = C.interval_pair_vector(c[0], c[1], c[0], c[2], c[3], c[2], c[4], c[5], 3.0, 2.0)
    out = p.select(*[x.alias(k) for k, x in f.items()], v.alias("v")).where("compatible")
    names = {"gaps": "interval_gap_seconds", "excess": "center_excess_normalized", "widths": "width_sum_normalized"}
    return out.agg(F.count("*").alias("pairs"), *[F.round(F.sum(c), 4).alias(n) for n, c in names.items()], F.round(F.sum("proposal_logit_sum"), 3).alias("logits"), F.round(F.sum(F.col("v")[13].cast("double")), 3).alias("overlaps"), F.round(F.sum(F.col("v")[4].cast("double")), 4).alias("score_gaps"))


WINDOWS = f"""w AS (SELECT us // 21600000000 * 21600 AS gps_start, us // 21600000000 * 21600 + 21600 AS gps_end, list_sort(list(DISTINCT event_type)) AS ifos FROM ev WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1, 2)"""


def _windows(spark, sf):
    s = F.floor(F.col("us") / (6 * HOUR * MICRO)) * (6 * HOUR)
    w = _events(spark, sf).where(F.col("event_type").isin("click", "purchase", "view")).groupBy(s.alias("gps_start")).agg(F.sort_array(F.collect_set("event_type")).alias("ifos"))
    return w.withColumns({"gps_end": F.col("gps_start") + 6 * HOUR, "window_id": F.col("gps_start")})


@query(f"""WITH {EV}, {WINDOWS}, x AS (SELECT unnest(ifos) AS ifo FROM w), e AS (SELECT ifo, count(*) * 21600 AS exposure FROM x GROUP BY 1),
d AS (SELECT value AS t, count(*) AS n FROM ev WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1), c AS (SELECT t, sum(n) OVER (ORDER BY t DESC) AS k FROM d),
f AS (SELECT min(t) AS t FROM c WHERE k / (SELECT sum(exposure) / 86400.0 FROM e) <= 0.5), s AS (SELECT event_type AS ifo, count(*) AS n FROM ev, f WHERE event_type IN ('click', 'purchase', 'view') AND value >= t GROUP BY 1)
SELECT ifo, exposure, coalesce(n, 0) AS survivors, round((SELECT t FROM f), 6) AS threshold, round(coalesce(n, 0) / (exposure / 86400.0), 9) AS rate FROM e LEFT JOIN s USING (ifo)""")
def detector_rates(spark, sf):
    """Exposure of each detector as a union of windows, one threshold, and the rate of each detector at it."""
    w = _windows(spark, sf)
    s = F.floor(F.col("us") / (6 * HOUR * MICRO)) * (6 * HOUR)
    c = _events(spark, sf).where(F.col("event_type").isin("click", "purchase", "view")).select(s.alias("window_id"), F.col("event_type").alias("ifo"), F.col("value").alias("score"))
    out = evaluation.detector_rates(w, c, "score", 0.5, float(DAY))
    return out.select("ifo", "exposure", "survivors", F.round("threshold", 6).alias("threshold"), F.round("rate", 9).alias("rate"))


@query(f"""WITH {EV}, {WINDOWS}, s AS (SELECT *, CASE WHEN gps_start // 86400 % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM w)
SELECT split, count(*) AS windows, count(*) * 21600 AS live_time, sum(len(ifos))::BIGINT * 21600 AS detector_time FROM s GROUP BY 1""")
def merged_background_splits(spark, sf):
    """Audited windows of several shards: live time and detector time of each split."""
    day = F.floor(F.col("gps_start") / DAY)
    w = _windows(spark, sf).withColumns({"split": F.when(day % 5 == 0, "val").otherwise("train"), "gps_block": day, "observing_run": F.lit("run")})
    return evaluation.merged_background(w)["splits"]


@query(f"""WITH {EV}, {WINDOWS} SELECT array_to_string(ifos, '') AS subset, count(*) AS windows FROM w GROUP BY 1""")
def detector_subsets(spark, sf):
    w = _windows(spark, sf).withColumns({"split": F.lit("train"), "gps_block": F.col("gps_start"), "observing_run": F.lit("run")})
    return evaluation.merged_background(w)["subsets"]


ENDPOINT = f"""WITH b AS (SELECT max(l_extendedprice) AS s FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey), i AS (SELECT o_orderpriority AS family, o_totalprice / 4 AS s, 1 + o_orderkey % 5 AS w FROM orders),
d AS (SELECT s, count(*) AS n FROM b GROUP BY 1), c AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS k FROM d), t AS (SELECT min(s) AS t, max(k) AS k FROM c WHERE k <= 50)
SELECT CASE WHEN grouping(family) = 1 THEN 'all' ELSE family END AS family, count(*) AS n, count(*) FILTER (WHERE s >= t) AS found, round(sum(CASE WHEN s >= t THEN w ELSE 0 END) / sum(w), 9) AS efficiency,
  round({_w('count(*) FILTER (WHERE s >= t)', 'count(*)', '-')}, 9) AS low, max(k)::BIGINT AS false_alarms, (SELECT count(*) * 10 FROM b) AS live_time FROM i, t GROUP BY GROUPING SETS ((), (family))"""


@query(ENDPOINT)
def endpoint_by_family(spark, sf):
    """Efficiency, overall and by family, at the threshold that fifty background windows reach at most."""
    b = _t(spark, sf, "lineitem").where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("window_id")).agg(F.max("l_extendedprice").alias("s")).withColumns({"gps_start": F.col("window_id") * 10, "gps_end": F.col("window_id") * 10 + 10})
    i = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("injection_id"), F.col("o_orderpriority").alias("family"), (F.col("o_totalprice") / 4).alias("s"), (1 + F.col("o_orderkey") % 5).alias("w"))
    out = evaluation.endpoint(b, i, "s", F.col("w"), "family", 50)
    return out.select(F.when(F.col("overall"), "all").otherwise(F.col("family")).alias("family"), "n", "found", F.round("efficiency", 9).alias("efficiency"), F.round("low", 9).alias("low"), "false_alarms", "live_time")


@query("""WITH b AS (SELECT l_extendedprice AS s FROM lineitem WHERE l_linenumber = 2), i AS (SELECT o_totalprice / 4 AS s, 1 + o_orderkey % 5 AS w FROM orders)
SELECT (SELECT count(*) FROM b WHERE s >= 60000) AS false_alarms, round((SELECT count(*) FROM b WHERE s >= 60000) / 20.0, 9) AS far, count(*) AS injections, count(*) FILTER (WHERE s >= 60000) AS recovered,
  round(sum(CASE WHEN s >= 60000 THEN w ELSE 0 END) / sum(w), 9) AS weighted_efficiency FROM i""")
def search_evaluation(spark, sf):
    """False alarms and efficiencies at a frozen threshold; the resampled interval is checked in tests."""
    b = _t(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_extendedprice").alias("s"))
    i = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 4).alias("s"), (1 + F.col("o_orderkey") % 5).alias("w"))
    out = evaluation.evaluate_search(b, i, "s", F.col("w"), 60000.0, 20.0, "o_orderkey", 200, 3)
    return out.select("false_alarms", F.round("far", 9).alias("far"), "injections", "recovered", F.round("weighted_efficiency", 9).alias("weighted_efficiency"))


@query("""WITH m AS (SELECT o_custkey, o_orderpriority AS d, max(o_totalprice) AS p FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1, 2), t AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY 1),
e AS (SELECT d, abs(p - v) AS x FROM m JOIN t USING (o_custkey) UNION ALL SELECT 'network', abs(median(p) - max(v)) FROM m JOIN t USING (o_custkey) GROUP BY o_custkey)
SELECT d AS detector, count(*) AS n, round(quantile_cont(x, 0.5), 4) AS median_error, round(quantile_cont(x, 0.9), 4) AS p90_error, count(*) FILTER (WHERE x <= 30000) AS within FROM e GROUP BY 1""")
def peak_timing_summary(spark, sf):
    """Errors of the peaks of each detector, and of their median, against a truth."""
    o = _t(spark, sf, "orders")
    m = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")).groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("p"))
    m = m.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "p"))).alias("peaks"))
    out = evaluation.timing_summary(m.join(o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v")), "o_custkey"), "peaks", "v", 30000.0)
    return out.select("detector", "n", F.round("median_error", 4).alias("median_error"), F.round("p90_error", 4).alias("p90_error"), "within")


@query("""WITH g AS (SELECT unnest([0.02, 0.04, 0.06, 0.08]) AS t), c AS (SELECT t, count(*) FILTER (WHERE l_discount >= t AND l_returnflag = 'R') AS tp, count(*) FILTER (WHERE l_discount >= t AND l_returnflag <> 'R') AS fp, count(*) FILTER (WHERE l_discount < t AND l_returnflag = 'R') AS fn FROM lineitem CROSS JOIN g GROUP BY 1)
SELECT t::DOUBLE AS threshold, tp, fp, fn, round(tp / greatest(tp + fp + fn, 1), 9) AS iou, round(tp / greatest(tp + fp, 1), 9) AS precision, round(tp / greatest(tp + fn, 1), 9) AS recall, row_number() OVER (ORDER BY tp / greatest(tp + fp + fn, 1) DESC, t) = 1 AS selected FROM c""")
def threshold_grid_scan(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_discount", (F.col("l_returnflag") == "R").alias("y"))
    out = evaluation.threshold_scan(li, [0.02, 0.04, 0.06, 0.08], "l_discount", F.col("y"))
    return out.withColumns({c: F.round(c, 9) for c in ("iou", "precision", "recall")})


@query("""SELECT lang AS value, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS unknown_rows, count(*) FILTER (WHERE toxic = 0) AS known_rows,
  CASE WHEN count(*) FILTER (WHERE toxic = 1) > 0 THEN round(count(*) FILTER (WHERE toxic = 1 AND n_chars > 2000) / count(*) FILTER (WHERE toxic = 1), 9) END AS unknown_true_abstention,
  CASE WHEN count(*) FILTER (WHERE toxic = 0) > 0 THEN round(count(*) FILTER (WHERE toxic = 0 AND n_chars > 2000) / count(*) FILTER (WHERE toxic = 0), 9) END AS known_false_abstention FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def abstention_by_value(spark, sf):
    j = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", (F.col("toxic") == 1).alias("u"), (F.col("n_chars") > 2000).alias("a"))
    out = evaluation.abstention_strata(j, "lang", "u", "a")
    return out.withColumns({c: F.round(c, 9) for c in ("unknown_true_abstention", "known_false_abstention")})


@query("""SELECT p_brand AS family, count(*) AS n, sum(p_size)::BIGINT AS tp, sum(p_partkey % 7)::BIGINT AS fp, sum(p_partkey % 5)::BIGINT AS fn, round(sum(p_size) / (sum(p_size) + sum(p_partkey % 7) + sum(p_partkey % 5)), 9) AS iou,
  round(sum(p_size) / (sum(p_size) + sum(p_partkey % 7)), 9) AS precision, round(sum(p_size) / (sum(p_size) + sum(p_partkey % 5)), 9) AS recall FROM part GROUP BY 1""")
def family_mask_counts(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_brand").alias("family"), F.col("p_size").cast("bigint").alias("a"), (F.col("p_partkey") % 7).alias("b"), (F.col("p_partkey") % 5).alias("c"))
    return evaluation.family_masks(p, "family", "a", "b", "c").withColumns({c: F.round(c, 9) for c in ("iou", "precision", "recall")})


def _groups(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("group_id"), F.when(F.col("l_orderkey") % 10 < 7, "train").otherwise("val").alias("split"), (F.col("l_returnflag") == "R").cast("int").alias("class_0"), (F.col("l_discount") > 0.08).cast("int").alias("class_1"))


GROUPS = "g AS (SELECT l_orderkey, CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'val' END AS split, count(*) AS images, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_discount > 0.08) AS b FROM lineitem GROUP BY 1)"


@query(f"""WITH {GROUPS} SELECT split, CASE WHEN a > 0 AND b > 0 THEN 'chirp+noise' WHEN a > 0 THEN 'chirp_only' WHEN b > 0 THEN 'noise_only' ELSE 'empty' END AS composition, count(*) AS groups FROM g GROUP BY 1, 2""")
def group_compositions(spark, sf):
    return audits.group_audit(_groups(spark, sf))["compositions"]


@query(f"""WITH {GROUPS} SELECT images, count(*) AS groups FROM g GROUP BY 1""")
def group_sizes(spark, sf):
    return audits.group_audit(_groups(spark, sf))["sizes"]


@query("""SELECT count(*) AS samples, count(DISTINCT source) AS groups, count(*) - count(DISTINCT sha256(text)) AS exact_duplicates, sum(n_chars)::BIGINT AS n_chars FROM documents""")
def sample_audit(spark, sf):
    d = _t(spark, sf, "documents").select("source", F.sha2("text", 256).alias("digest"), "n_chars")
    return audits.sample_audit(d, "digest", "source", ["n_chars"])


@query("""WITH p AS (SELECT DISTINCT l_returnflag || l_linestatus AS s, l_partkey AS g FROM lineitem) SELECT a.s AS "left", b.s AS "right", count(*) AS shared FROM p a JOIN p b ON a.g = b.g AND a.s < b.s GROUP BY 1, 2""")
def source_group_overlap(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("s"), F.col("l_partkey").alias("g"))
    return audits.source_overlaps(li, "s", "g")


@query("""SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def field_histograms(spark, sf):
    return audits.field_histograms(_t(spark, sf, "documents").select("lang", "source"), ["lang", "source"])


@query("""SELECT 'c_mktsegment' AS field, count(DISTINCT c_mktsegment) AS n FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer""")
def field_cardinalities(spark, sf):
    return audits.distinct_counts(_t(spark, sf, "customer").select("c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"])


QUOTA = """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('"5:' || c_custkey || ':snr-quota-assignment"'), c_custkey) - 1 AS i, count(*) OVER () AS n,
  ('0x' || substr(sha256('"5:' || c_custkey || ':snr-quota-target"'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM customer),
e(b, lo, hi, share) AS (VALUES (0, 4.0, 8.0, 0.4), (1, 8.0, 15.0, 0.35), (2, 15.0, 30.0, 0.25)), x AS (SELECT *, (SELECT max(n) FROM r) * share AS exact FROM e),
k AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, b) <= (SELECT max(n) FROM r) - (SELECT sum(floor(exact)) FROM x) THEN 1 ELSE 0 END AS k FROM x),
c AS (SELECT *, sum(k) OVER (ORDER BY b) - k AS first FROM k)
SELECT lo::INTEGER || '-' || hi::INTEGER AS bin, count(*) AS n, min(c_custkey) AS least, sum(c_custkey)::BIGINT AS ids, round(sum(lo * pow(hi / lo, u)), 3) AS targets FROM r JOIN c ON i >= first AND i < first + k GROUP BY 1"""


@query(QUOTA)
def snr_quota(spark, sf):
    """Exact quotas by hash order, and a log-uniform target in each bin."""
    out = selection.quota_bins(spark, _t(spark, sf, "customer").select("c_custkey"), "c_custkey", [(4.0, 8.0, 0.4), (8.0, 15.0, 0.35), (15.0, 30.0, 0.25)], 5)
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.min("c_custkey").alias("least"), F.sum("c_custkey").alias("ids"), F.round(F.sum("target"), 3).alias("targets"))


@query("""WITH y AS (SELECT l_linestatus AS mode, year(l_shipdate) AS scale, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT *, v - first_value(v) OVER o AS gain, v - lag(v) OVER o AS change FROM y WINDOW o AS (PARTITION BY mode ORDER BY scale))
SELECT mode, scale::INTEGER AS scale, round(gain, 9) AS gain, round(change, 9) AS change, min(coalesce(change, 0)) OVER (PARTITION BY mode) >= -0.001 AS nearly_monotonic, last_value(gain) OVER (PARTITION BY mode ORDER BY scale ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) >= 0 AS enough FROM w""")
def scaling_curve(spark, sf):
    y = _t(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("mode"), F.year("l_shipdate").alias("scale")).agg(F.avg("l_discount").alias("v"))
    out = evaluation.scaling_curve(y, ["mode"], "scale", "v", 0.001, 0.0)
    return out.select("mode", "scale", F.round("gain", 9).alias("gain"), F.round("change", 9).alias("change"), "nearly_monotonic", "enough")


CATALOG = "p AS (SELECT o_custkey AS event, o_totalprice > 150000 AS hit FROM orders), c AS (SELECT c_custkey AS k, c_acctbal / 200 AS snr FROM customer WHERE c_custkey % 4 <> 0), j AS (SELECT event, hit, k IS NOT NULL AS matched, snr FROM p LEFT JOIN c ON event = k)"


def _catalog(spark, sf):
    p = _t(spark, sf, "orders").select(F.col("o_custkey").alias("event"), (F.col("o_totalprice") > 150000).alias("hit"))
    c = _t(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("commonName"), (F.col("c_acctbal") / 200).alias("snr"))
    return evaluation.catalog_hits(p, c, "snr", "hit")


@query(f"""WITH {CATALOG} SELECT count(*) AS images, count(*) FILTER (WHERE matched) AS matches, count(*) FILTER (WHERE matched AND hit) AS hits, round({_w('count(*) FILTER (WHERE matched AND hit)', 'count(*) FILTER (WHERE matched)', '+')}, 9) AS high FROM j""")
def catalog_hit_rate(spark, sf):
    return _catalog(spark, sf)[0].select("images", "matches", "hits", F.round("high", 9).alias("high"))


@query(f"""WITH {CATALOG} SELECT event, round(snr, 6) AS snr FROM j WHERE matched AND NOT hit AND snr >= 20""")
def loud_misses(spark, sf):
    return _catalog(spark, sf)[1].select("event", F.round("snr", 6).alias("snr"))


ARMS = """s AS (SELECT l_orderkey AS injection_id, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) AS b, max(CASE WHEN l_linenumber = 3 THEN l_extendedprice END) AS c, max(l_quantity) AS w FROM lineitem GROUP BY 1),
x AS (SELECT injection_id, w, least(a, b) AS hl, least(a, c) AS hv, least(b, c) AS lv, list_sort([a, b, c], 'DESC')[2] AS hlv FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)"""


@query(f"""WITH {ARMS}, r AS (SELECT sum(CASE WHEN hlv >= 40000 THEN w ELSE 0 END) AS r FROM x), y AS (SELECT 'H+L' AS arm, hl AS s, w, 30000 AS t FROM x UNION ALL SELECT 'H+V', hv, w, 30000 FROM x UNION ALL SELECT 'L+V', lv, w, 30000 FROM x UNION ALL SELECT 'H+L+V', hlv, w, 40000 FROM x)
SELECT arm, count(*) AS injections, round(sum(CASE WHEN s >= t THEN w ELSE 0 END), 2) AS weight_arm, round(sum(CASE WHEN s >= t THEN w ELSE 0 END) / max(r) - 1, 9) AS relative_delta, sum(CASE WHEN s >= t THEN w ELSE 0 END) / max(r) - 1 >= -0.1 AS passed, true AS complete FROM y, r GROUP BY 1""")
def detector_subset_arms(spark, sf):
    """Each subset of three detectors against all three, on the same injections."""
    n = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("l_extendedprice")))
    s = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("injection_id")).agg(n(1).alias("a"), n(2).alias("b"), n(3).alias("c"), F.max("l_quantity").alias("weight")).where("a is not null and b is not null and c is not null")
    a, b, c = (F.col(x) for x in "abc")
    arms = {"H+L": F.least(a, b), "H+V": F.least(a, c), "L+V": F.least(b, c), "H+L+V": C.network_rank(F.array(a, b, c))}
    long = s.withColumn("e", F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), v.alias("score")) for k, v in arms.items()]))).select("e.arm", "injection_id", F.col("injection_id").alias("waveform_id"), "weight", "e.score")
    cut = spark.createDataFrame([(k, 40000.0 if k == "H+L+V" else 30000.0) for k in arms], "arm string, threshold double")
    out = evaluation.subset_arms(long, cut, ["H", "L", "V"], ["H", "L", "V"], 0.1)
    return out.select("arm", "injections", F.round("weight_arm", 2).alias("weight_arm"), F.round("relative_delta", 9).alias("relative_delta"), "passed", "complete")


@query("""WITH j AS (SELECT o_orderpriority AS stratum, 1 + o_orderkey % 3 AS w, o_totalprice >= 150000 AS x, o_totalprice * 1.1 - o_orderkey % 100 * 300 >= 150000 AS y FROM orders),
s AS (SELECT stratum, sum(CASE WHEN x THEN w ELSE 0 END) / sum(w) AS a, sum(CASE WHEN y THEN w ELSE 0 END) / sum(w) AS b FROM j GROUP BY 1)
SELECT count(*) AS strata, count(*) FILTER (WHERE b - a < -0.01) AS regressions, round(min(b - a), 9) AS worst FROM s""")
def regressing_strata(spark, sf):
    """Two runs over the same rows: strata that lose more than a margin."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stratum"), (1 + F.col("o_orderkey") % 3).alias("w"), F.col("o_totalprice").alias("s"))
    new = o.withColumn("s", F.col("s") * 1.1 - F.col("o_orderkey") % 100 * 300)
    out = evaluation.regressing_strata(evaluation.compare_runs(o, new, ["o_orderkey"], ["stratum"], "s", "w", "stratum", (150000.0, 150000.0)), 0.01)
    return out.withColumn("worst", F.round("worst", 9))


@query("""WITH r AS (SELECT l_returnflag AS arm, l_linenumber AS seed, l_linestatus AS mode, avg(l_discount) AS v FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' GROUP BY 1, 2, 3),
w AS (SELECT mode, seed, max(v) FILTER (WHERE arm = 'R') - max(v) FILTER (WHERE arm = 'A') AS d FROM r GROUP BY 1, 2)
SELECT mode, count(d) AS pairs, round(avg(d), 9) AS mean_delta, round(min(d), 9) AS least_delta, count(d) >= 3 AND count(*) = count(d) AND avg(d) > 0 AS passed FROM w GROUP BY 1""")
def arms_paired_on_seed(spark, sf):
    r = _t(spark, sf, "lineitem").where("l_returnflag in ('A', 'R') and l_linestatus = 'F'").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed"), F.col("l_linestatus").alias("mode")).agg(F.avg("l_discount").alias("v"))
    out = evaluation.seed_pairs(r, ("A", "R"), "v", 3)
    return out.select("mode", "pairs", F.round("mean_delta", 9).alias("mean_delta"), F.round("least_delta", 9).alias("least_delta"), "passed")


@query(f"""WITH {EV}, g AS (SELECT event_type AS ifo, us // 7200000000 * 7200 AS s FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2), p AS (SELECT event_id, us / 1e6 AS t FROM ev WHERE event_type = 'view'),
j AS (SELECT event_id, d.d, t, g.s FROM p CROSS JOIN (SELECT unnest(['click', 'view']) AS d) d ASOF JOIN g ON g.ifo = d.d AND g.s <= t),
k AS (SELECT event_id, count(*) AS n, bool_or(d = 'view') AS own, max(CASE WHEN d = 'click' THEN s END)::BIGINT AS click, max(CASE WHEN d = 'view' THEN s END)::BIGINT AS view FROM j WHERE s <= t - 60 AND s + 7200 >= t + 60 GROUP BY 1)
SELECT event_id, n AS detectors, click, view FROM k WHERE own AND n >= 2""")
def asof_segments(spark, sf):
    """The segment of each detector that is the last to start before an event and holds its context; two are needed."""
    e = _events(spark, sf)
    s = F.floor(F.col("us") / (2 * HOUR * MICRO)) * (2 * HOUR)
    g = e.where(F.col("event_type").isin("click", "view")).select(F.lit("run").alias("run"), F.col("event_type").alias("ifo"), s.alias("start")).distinct().withColumns({"end": F.col("start") + 2 * HOUR, "segment": F.col("start")})
    p = e.where("event_type = 'view'").select("event_id", F.lit("run").alias("run"), F.lit("view").alias("ifo"), (F.col("us") / 1e6).alias("t"))
    out = joins.asof_by_detector(p, g, ["click", "view"], 2, 120.0)
    return out.select("event_id", F.size("segments").cast("bigint").alias("detectors"), *[F.try_element_at("segments", F.lit(d)).alias(d) for d in ("click", "view")])


@query("""WITH w AS (SELECT p_partkey, least(greatest(p_size / 20.0 / 2, 8.0 / 16), 4.0) AS ht, greatest(100 / 15.0, p_retailprice / 20 / (1 + p_partkey % 9)) AS hf, p_retailprice / 20 AS f FROM part),
x AS (SELECT p_partkey, len(list_filter(range(0, 16), lambda i: abs(i * 0.5 - 4) <= ht)) AS t, len(list_filter(range(0, 16), lambda i: abs(i * (100 / 15.0) + 10 - f) <= hf)) AS k FROM w)
SELECT t, k, count(*) AS n FROM (SELECT t::INTEGER AS t, k::INTEGER AS k FROM x WHERE t > 0) GROUP BY 1, 2""")
def weak_masks(spark, sf):
    """Rectangles about triggers: time bins and frequencies that each covers."""
    p = _t(spark, sf, "part").select((F.col("p_size") / 20.0).alias("d"), (F.col("p_retailprice") / 20).alias("f"), (1 + F.col("p_partkey") % 9).alias("q"))
    m = p.select(C.weak_mask(F.col("d"), F.col("f"), F.col("q"), 16, 16, 10.0, 110.0, 8.0).alias("m"), F.greatest(F.col("d") / 2, F.lit(0.5)).alias("h"))
    on = lambda row: F.aggregate(row, F.lit(0), lambda a, x: a + x)
    t = F.size(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.abs(i * 0.5 - 4) <= F.least("h", F.lit(4.0))))
    k = F.size(F.filter("m", lambda row: on(row) > 0))
    return m.select(F.coalesce(F.array_max(F.transform("m", on)), F.lit(0)).alias("most"), t.alias("t"), k.alias("k")).where("most = t or k = 0").groupBy("t", "k").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS p, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY sha256('4:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)) AS i FROM lineitem)
SELECT p AS positive, count(*) AS n, count(DISTINCT l_orderkey) AS parents FROM r WHERE p OR i <= 2 GROUP BY 1""")
def positives_and_some(spark, sf):
    """All positives of each parent and at most two of the others."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("p"))
    out = selection.positives_and_some(li, ["l_orderkey"], F.col("p"), [C.seeded_hash(4, *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])], 2)
    return out.groupBy(F.col("p").alias("positive")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("parents"))


@query("""SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_nationkey, round(s_acctbal / 1000) DESC, s_suppkey LIMIT 1""")
def best_qualified(spark, sf):
    s = _t(spark, sf, "supplier")
    return selection.best_qualified(s, F.col("s_acctbal") > 0, ["s_nationkey", F.desc(F.round(F.col("s_acctbal") / 1000)), "s_suppkey"]).select("s_suppkey", "s_nationkey")


@query("""WITH k AS (SELECT DISTINCT l_suppkey, sha256('' || l_suppkey) AS h FROM lineitem), s AS (SELECT l_suppkey, (row_number() OVER (ORDER BY h) - 1) // 7 AS shard FROM k)
SELECT shard, count(*) AS rows, count(DISTINCT l_suppkey) AS keys FROM lineitem JOIN s USING (l_suppkey) GROUP BY 1""")
def shard_ids(spark, sf):
    """Shards of seven suppliers each in the order of their hashes; a supplier's lines stay together."""
    li = _t(spark, sf, "lineitem").select("l_suppkey")
    out = selection.shard_ids(spark, li, F.sha2(F.col("l_suppkey").cast("string"), 256), 7)
    return out.groupBy("shard").agg(F.count("*").alias("rows"), F.count_distinct("l_suppkey").alias("keys"))


@query("""WITH r AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS position FROM nation) SELECT n_regionkey, n_nationkey, position FROM r WHERE position >= 2 AND position < 4""")
def positional_slice(spark, sf):
    return selection.positional_slice(_t(spark, sf, "nation"), ["n_name"], 1, 2, ["n_regionkey"]).select("n_regionkey", "n_nationkey", F.col("position").cast("bigint").alias("position"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def contract_duplicates(spark, sf):
    return contracts.duplicates(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("""SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def contract_missing_references(spark, sf):
    o = _t(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return contracts.missing_references(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), o, "o_orderkey")


@query("""SELECT p_partkey, list_filter(['price', 'size'], lambda n: CASE WHEN n = 'price' THEN NOT (p_retailprice BETWEEN 950 AND 1900) ELSE p_size % 5 = 0 END) AS failed FROM part WHERE NOT (p_retailprice BETWEEN 950 AND 1900) OR p_size % 5 = 0""")
def contract_checks(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return contracts.failing(p, price=F.col("p_retailprice").between(950, 1900), size=F.col("p_size") % 5 != 0).select("p_partkey", "failed")


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""")
def contract_dependencies(spark, sf):
    return contracts.broken_dependency(_t(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@query("""SELECT field, value FROM (SELECT 'c_nationkey' AS field, c_nationkey::VARCHAR AS value FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT 'c_nationkey', s_nationkey::VARCHAR FROM supplier)""")
def contract_shared_values(spark, sf):
    c = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_nationkey")
    return contracts.shared_values(c, _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey")


@query(f"""WITH {EV}, a AS (SELECT user_id AS injection_id, event_type AS ifo, min(us) / 1e6 AS arrival FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2), p AS (SELECT user_id AS injection_id, event_type AS ifo, us / 1e6 - 30 AS s, us / 1e6 - 5 AS e FROM ev WHERE event_type IN ('click', 'view') AND event_id % 3 = 0),
j AS (SELECT a.*, p.s, p.e FROM a LEFT JOIN p USING (injection_id, ifo)), g AS (SELECT injection_id, ifo, count(s) AS n, coalesce(bool_or(s <= arrival AND arrival <= e), false) AS i, coalesce(bool_or(s - 10 <= arrival AND arrival <= e + 10), false) AS p, min(greatest(s - arrival, 0, arrival - e)) AS d FROM j GROUP BY 1, 2)
SELECT ifo, count(*) AS arrivals, sum(n)::BIGINT AS proposals, count(*) FILTER (WHERE i) AS inside, count(*) FILTER (WHERE p) AS padded, round(sum(d), 3) AS distance FROM g GROUP BY 1""")
def proposal_coverage(spark, sf):
    """Arrivals with the proposals of their detector; those without one stay as misses."""
    e = _events(spark, sf).where(F.col("event_type").isin("click", "view")).select(F.col("user_id").alias("injection_id"), F.col("event_type").alias("ifo"), (F.col("us") / 1e6).alias("t"), "event_id")
    a = e.groupBy("injection_id", "ifo").agg(F.min("t").alias("arrival"))
    p = e.where("event_id % 3 = 0").select("injection_id", "ifo", (F.col("t") - 30).alias("gps_start"), (F.col("t") - 5).alias("gps_end"))
    c = search.proposal_coverage(a, p, 10.0)
    return c.groupBy("ifo").agg(F.count("*").alias("arrivals"), F.sum("proposals").alias("proposals"), F.count_if("inside").alias("inside"), F.count_if("padded").alias("padded"), F.round(F.sum("distance"), 3).alias("distance"))


@query(f"""WITH {EV}, i AS (SELECT user_id AS injection_id, min(us) FILTER (WHERE event_type = 'click') / 1e6 AS t1, min(us) FILTER (WHERE event_type = 'view') / 1e6 AS t2 FROM ev GROUP BY 1), c AS (SELECT event_id, user_id AS injection_id, event_type, us / 1e6 AS p, value AS s FROM ev WHERE event_type IN ('click', 'view')),
j AS (SELECT i.injection_id, a.event_id AS c1, b.event_id AS c2, least(a.s, b.s) AS score, row_number() OVER (PARTITION BY i.injection_id ORDER BY least(a.s, b.s) DESC, a.event_id, b.event_id) AS nth FROM i JOIN c a ON a.injection_id = i.injection_id AND a.event_type = 'click' JOIN c b ON b.injection_id = i.injection_id AND b.event_type = 'view'
  WHERE abs(a.p - t1) <= 300000 AND abs(b.p - t2) <= 300000 AND abs(a.p - b.p) <= 200000 + 2 * 1000)
SELECT i.injection_id, c1, c2, j.nth IS NOT NULL AS found_pair, round(coalesce(score, 0), 6) AS ranking_score FROM i LEFT JOIN j ON j.injection_id = i.injection_id AND nth = 1 WHERE t1 IS NOT NULL AND t2 IS NOT NULL""")
def injection_rankings(spark, sf):
    """The best pair of candidates of each injection with both arrivals; those without a pair have the score 0."""
    e = _events(spark, sf).where(F.col("event_type").isin("click", "view")).select("event_id", F.col("user_id").alias("injection_id"), F.col("event_type").alias("ifo"), (F.col("us") / 1e6).alias("gps_peak"), F.col("value").alias("score"))
    first = e.groupBy("injection_id", "ifo").agg(F.min("gps_peak").alias("t")).groupBy("injection_id").agg(F.map_from_entries(F.collect_list(F.struct("ifo", "t"))).alias("detector_arrival_gps"))
    out = search.injection_rankings(first, e.withColumnRenamed("event_id", "candidate_id"), "click", "view", 200000.0, 1000.0, 300000.0)
    return out.select("injection_id", "c1", "c2", "found_pair", F.round("ranking_score", 6).alias("ranking_score"))


@query("""WITH l AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 = 0), m AS (SELECT n_regionkey, list_sort(list(n_nationkey)) AS v FROM nation GROUP BY 1)
SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, round(count(*) FILTER (WHERE quality = 1 AND toxic = 0) / count(*) FILTER (WHERE quality = 1), 9) AS precision, round(count(*) FILTER (WHERE quality = 1 AND toxic = 0) / count(*) FILTER (WHERE toxic = 0), 9) AS recall FROM l""")
def binary_metrics(spark, sf):
    q, t = F.col("quality") == 1, F.col("toxic") == 0
    c = _t(spark, sf, "labels").where("doc_id % 3 = 0").agg(F.count_if(q & t).alias("tp"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn"), F.count_if(~q & ~t).alias("tn"))
    m = C.binary_metrics(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    return c.select("tp", F.round(m["precision"], 9).alias("precision"), F.round(m["recall"], 9).alias("recall"))


@query("""WITH r AS (SELECT c_mktsegment AS g, c_nationkey % 2 = 0 AS has, c_acctbal AS s, count(*) OVER () AS n FROM customer), d AS (SELECT g, s AS threshold, count(*) AS n FROM r WHERE has GROUP BY 1, 2 HAVING g <> 'BUILDING'), c AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY threshold DESC) AS k FROM d),
t AS (SELECT g, min(threshold) AS t, max(k) AS k FROM c WHERE k / 10.0 <= 2 GROUP BY 1) SELECT s.g AS key, coalesce(t, 1.7976931348623157e308) AS threshold, coalesce(k, 0)::BIGINT AS survivors FROM (SELECT DISTINCT c_mktsegment AS g FROM customer) s LEFT JOIN t ON s.g = t.g""")
def threshold_without_background(spark, sf):
    """A key without background gets the largest number there is as its threshold."""
    c = _t(spark, sf, "customer").withColumn("key", F.col("c_mktsegment"))
    out = stats.threshold_at_rate(c.where("c_nationkey % 2 = 0 and key <> 'BUILDING'"), ["key"], "c_acctbal", F.lit(10.0), 2.0, c.select("key").distinct())
    return out.select("key", "threshold", F.col("survivors").cast("bigint").alias("survivors"))


@query()
def restart_split(spark, sf):
    """Suppliers split by nation counts: the best of forty greedy splits; tests hold it against its score."""
    s = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("group_id")).agg(F.count("*").alias("samples"), F.count_if(F.col("s_acctbal") > 5000).alias("class_0"), F.count_if(F.col("s_acctbal") < 0).alias("class_1"))
    return graph.restart_split(spark, s, {"train": 0.6, "val": 0.2, "test": 0.2}, 40, 3)


@query("""WITH a AS (SELECT p_partkey % 97 AS task, p_partkey % 3 AS who, list_transform(range(0, 6), lambda i: ((p_partkey // 97 + p_size + i * p_size) % 3 = 0)::INTEGER) AS m, row_number() OVER (PARTITION BY p_partkey % 97, p_partkey % 3 ORDER BY p_partkey) AS nth FROM part),
x AS (SELECT * FROM a WHERE nth = 1), c AS (SELECT task, count(*) AS panel FROM x GROUP BY 1 HAVING count(*) = 3), v AS (SELECT task, i, avg(m[i + 1]) AS s FROM x CROSS JOIN (SELECT unnest(range(0, 6)) AS i) GROUP BY 1, 2), j AS (SELECT task, list((s >= 0.5)::INTEGER ORDER BY i) AS majority FROM v GROUP BY 1)
SELECT c.task, panel, majority FROM c JOIN j USING (task)""")
def annotation_consensus(spark, sf):
    """Majority masks of panels of three."""
    i = F.sequence(F.lit(0), F.lit(5))
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 97).alias("task"), (F.col("p_partkey") % 3).alias("who"), F.transform(i, lambda k: ((F.expr("p_partkey div 97") + F.col("p_size") + k * F.col("p_size")) % 3 == 0).cast("int")).alias("m"))
    first = selection.top_k(p, ["task", "who"], ["p_partkey"], 1).drop("nth")
    return calibration.annotation_consensus(first, "task", "who", "m", 3).select("task", "panel", "majority")


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS a, p_size // 4 % 4 AS b, p_partkey % 4 AS c FROM part), f AS (SELECT p_partkey, [(a > 0)::INTEGER, (b > 0)::INTEGER, (c > 0)::INTEGER] AS flags, CASE p_partkey % 3 WHEN 0 THEN a > 0 WHEN 1 THEN b > 0 ELSE c > 0 END AS own FROM p)
SELECT flags, CASE WHEN NOT own THEN 'event_ifo_unusable' WHEN flags[1] + flags[2] + flags[3] < 2 THEN 'fewer_than_two_usable_detectors' ELSE 'usable' END AS reason, count(*) AS n FROM f GROUP BY 1, 2""")
def detector_availability(spark, sf):
    k = F.col("p_partkey")
    p = _t(spark, sf, "part").select(F.create_map(F.lit("H"), F.col("p_size") % 4 > 0, F.lit("L"), F.expr("p_size div 4 % 4") > 0, F.lit("V"), k % 4 > 0).alias("m"), F.when(k % 3 == 0, "H").when(k % 3 == 1, "L").otherwise("V").alias("own"))
    flags, reason = C.detector_availability(F.col("m"), ["H", "L", "V"], F.col("own"))
    return p.select(flags.alias("flags"), F.coalesce(reason, F.lit("usable")).alias("reason")).groupBy("flags", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, h AS (SELECT us // 86400000000 AS d, us // 3600000000 % 24 AS h, event_type, count(*)::DOUBLE AS n FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3), m AS (SELECT d, max(n) AS score FROM h GROUP BY 1)
SELECT m.d AS day, score, min(h)::INTEGER AS time_bin, round(m.d * 24 + (min(h) + 0.5), 6) AS peak FROM m JOIN h ON h.d = m.d AND h.n = m.score GROUP BY 1, 2""")
def nested_peaks(spark, sf):
    """The largest value over several profiles of a day, and the first time bin that has it."""
    e = _events(spark, sf).where(F.col("event_type").isin("click", "view")).groupBy(F.floor(F.col("us") / (DAY * MICRO)).alias("day"), "event_type", (F.floor(F.col("us") / (HOUR * MICRO)) % 24).cast("int").alias("h")).agg(F.count("*").cast("double").alias("n"))
    m = e.groupBy("day", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"))
    p = m.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))).groupBy("day").agg(F.collect_list("v").alias("p"))
    score, at, peak = C.peak_time(F.col("p"), F.col("day") * 24, F.lit(24))
    return p.select("day", score.alias("score"), at.alias("time_bin"), F.round(peak, 6).alias("peak"))


@query(f"""WITH {EV}, h AS (SELECT us // 3600000000 * 3600 AS w, max(value) FILTER (WHERE event_type = 'purchase') AS a, max(value) FILTER (WHERE event_type = 'view') AS b FROM ev GROUP BY 1), h2 AS (SELECT * FROM h WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT k::INTEGER AS slide, count(*) AS pairs, round(sum(least(x.a, y.b)), 4) AS ranks FROM h2 x CROSS JOIN (SELECT unnest(range(1, 6)) AS k) JOIN h2 y ON y.w = x.w + k * 3600 GROUP BY 1""")
def window_slides(spark, sf):
    """Scored windows with both detectors, shifted against each other."""
    v = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    w = _events(spark, sf).groupBy((F.floor(F.col("us") / (HOUR * MICRO)) * HOUR).alias("gps_start")).agg(v("purchase").alias("a"), v("view").alias("b")).where("a is not null and b is not null")
    gps = lambda d: F.struct(F.lit(float(d)).alias("gps"))
    t = w.select(F.col("gps_start").cast("string").alias("window_id"), "gps_start", (F.col("gps_start") + HOUR).alias("gps_end"), F.array(F.lit("A"), F.lit("B")).alias("valid_ifos"), F.create_map(F.lit("A"), F.col("a"), F.lit("B"), F.col("b")).alias("chirp_scores"), F.create_map(F.lit("chirp"), F.create_map(F.lit("A"), gps(0), F.lit("B"), gps(0))).alias("peak_times"))
    out = search.window_slides(t, search.slide_table(spark, 1, 5, HOUR), "A", "B")
    return out.groupBy("slide").agg(F.count("*").alias("pairs"), F.round(F.sum("ranking_score"), 4).alias("ranks"))


@query(f"""WITH {EV}, i AS (SELECT user_id, us - 1800000000 AS s, us + 1800000000 AS e FROM ev), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY user_id, k""")
def merged_islands(spark, sf):
    """Islands of overlapping or touching intervals."""
    e = _events(spark, sf).select("user_id", (F.col("us") - 1800 * MICRO).alias("s"), (F.col("us") + 1800 * MICRO).alias("e"))
    return intervals.merged_intervals(e, ["user_id"], "s", "e").select("user_id", "s", "e", "members")


MINUTES = f"""WITH {EV}, w AS (SELECT us // 60000000 * 60 AS s, bool_or(event_type = 'purchase') AS a, bool_or(event_type = 'view') AS b FROM ev GROUP BY 1),
x AS (SELECT (b.s - a.s) // 120 AS lag, count(*) AS pairs FROM w a JOIN w b ON b.s > a.s AND (b.s - a.s) % 120 = 0 AND a.a AND b.b GROUP BY 1)"""


def _minutes(spark, sf):
    """Windows of a minute that hold an event, with the event types that are in them as detectors."""
    at = F.floor(F.col("us") / (60 * MICRO)) * 60
    return _events(spark, sf).groupBy(at.alias("gps_start")).agg(F.collect_set("event_type").alias("ifos")).withColumn("gps_end", F.col("gps_start") + 60)


@query(f"{MINUTES} SELECT lag, pairs, pairs * 60 AS exposure FROM x")
def lag_exposure_all(spark, sf):
    """Pairs of windows and their live time for every lag of two minutes, from bitmaps: no lag costs a join."""
    return exposure.lag_exposure(_minutes(spark, sf), 120, "purchase", "view")


@query(f"""{MINUTES}, t AS (SELECT count(*) AS lags, sum(pairs)::BIGINT AS pairs, sum(pairs) * 60.0 AS live FROM x), n AS (SELECT count(*) AS n FROM w)
SELECT lags, pairs, live::DOUBLE AS live_time, n AS windows, round(-ln(0.1) / (live / 31557600.0), 6) AS rate_limit, live >= -ln(0.1) / 100 * 31557600.0 AS reached,
  ceil((1 + sqrt(1 + 8 * (-ln(0.1) / 100 * 31557600.0) / 60)) / 2)::INTEGER AS least_windows FROM t, n""")
def exposure_plan(spark, sf):
    """What all lags together say of a rate of 100 a year at 90 %."""
    w = _minutes(spark, sf)
    out = exposure.exposure_plan(exposure.lag_exposure(w, 120, "purchase", "view"), w.count(), 60.0, 100.0)
    return out.select("lags", "pairs", "live_time", F.col("windows").cast("bigint").alias("windows"), F.round("rate_limit", 6).alias("rate_limit"), "reached", "least_windows")


@query("""SELECT l_returnflag AS key, count(*) AS n, 40 AS replicates, count(*) AS least_draws, count(*) AS most_draws, true AS centred FROM lineitem GROUP BY 1""")
def exact_resamples(spark, sf):
    """Resamples of the lines of each flag: each draws as many as there are, and their sums lie around the true sum."""
    li = _t(spark, sf, "lineitem").select("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"), "l_quantity")
    own = li.groupBy(F.col("l_returnflag").alias("key")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"), F.stddev_pop("l_quantity").alias("spread"))
    r = resampling.replicate_sums(li, ["l_returnflag"], "row", {"v": F.col("l_quantity")}, 40, 3).groupBy(F.col("l_returnflag").alias("key"))
    r = r.agg(F.count("*").cast("int").alias("replicates"), F.min("draws").alias("least_draws"), F.max("draws").alias("most_draws"), F.avg("v").alias("mean"))
    off = F.abs(F.col("mean") - F.col("total")) <= 5 * F.col("spread") * F.sqrt("n") / F.sqrt("replicates")
    return own.join(r, "key").select("key", "n", "replicates", "least_draws", "most_draws", off.alias("centred"))


@query("""WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, 1 + c_custkey % 7 AS n FROM customer),
p(i, n, shard, used) AS (SELECT i, n, 0, n FROM c WHERE i = 1 UNION ALL
  SELECT c.i, c.n, CASE WHEN used + c.n > 20 THEN shard + 1 ELSE shard END, CASE WHEN used + c.n > 20 THEN c.n ELSE used + c.n END FROM p JOIN c ON c.i = p.i + 1)
SELECT shard::BIGINT AS shard, count(*) AS members, sum(n)::BIGINT AS total FROM p GROUP BY 1""")
def next_fit_shards(spark, sf):
    """Customers in order, packed into shards of 20; ranges are small here, so that their maps are joined in two levels."""
    c = _t(spark, sf, "customer").select("c_custkey", (1 + F.col("c_custkey") % 7).alias("n"))
    return packing.next_fit(spark, c, ["c_custkey"], "n", 20, each=16).groupBy("shard").agg(F.count("*").alias("members"), F.sum("n").alias("total"))


@query("""WITH v AS (SELECT 'documents' AS m, 'doc_id' AS field, doc_id::VARCHAR AS value FROM documents UNION SELECT 'labels', 'doc_id', doc_id::VARCHAR FROM labels UNION SELECT 'toxic', 'doc_id', doc_id::VARCHAR FROM labels WHERE toxic = 1
  UNION SELECT 'documents', 'lang', lang FROM documents WHERE lang IS NOT NULL),
i AS (SELECT *, CASE m WHEN 'documents' THEN 0 WHEN 'labels' THEN 1 ELSE 2 END AS i FROM v)
SELECT a.field, a.m AS "left", b.m AS "right", count(*) AS shared FROM i a JOIN i b ON a.field = b.field AND a.value = b.value AND a.i <= b.i GROUP BY 1, 2, 3""")
def manifest_overlaps(spark, sf):
    """What every two of three manifests share of two fields, from one bit mask for each value."""
    labels = _t(spark, sf, "labels").select("doc_id", "toxic")
    return audits.manifest_overlaps({"documents": _t(spark, sf, "documents").select("doc_id", "lang"), "labels": labels, "toxic": labels.where("toxic = 1")}, ["doc_id", "lang"])


def _allocation_sql(shares):
    """Scales one after the other, each a sort of all rows that a stratum could still give."""
    steps = ["s0 AS (SELECT lang, source, count(*) AS n, 0::BIGINT AS have FROM documents GROUP BY 1, 2), t AS (SELECT sum(n)::BIGINT AS total FROM s0)"]
    for i, share in enumerate(shares):
        steps.append(f"""q{i} AS (SELECT lang, source, n, j, floor(total * {share})::BIGINT AS scale, floor(total * {share}) * n / total - j AS lack FROM s{i} CROSS JOIN t CROSS JOIN LATERAL (SELECT unnest(range(have, n)) AS j)),
o{i} AS (SELECT *, row_number() OVER (ORDER BY lack DESC, j, lang DESC NULLS LAST, source DESC NULLS LAST) AS nth FROM q{i}),
s{i + 1} AS (SELECT s.lang, s.source, s.n, s.have + count(o.j) AS have FROM s{i} s LEFT JOIN o{i} o ON o.lang IS NOT DISTINCT FROM s.lang AND o.source IS NOT DISTINCT FROM s.source
  AND o.nth <= o.scale - (SELECT sum(have) FROM s{i}) GROUP BY 1, 2, 3, s.have)""")
    steps.append("r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('5:' || doc_id), doc_id) AS i FROM documents)")
    parts = [f"SELECT floor(total * {x})::BIGINT AS scale, r.lang, r.source, doc_id FROM r JOIN s{k + 1} s ON r.lang IS NOT DISTINCT FROM s.lang AND r.source IS NOT DISTINCT FROM s.source AND i <= have CROSS JOIN t" for k, x in enumerate(shares)]
    return f"WITH {', '.join(steps)}, u AS ({' UNION ALL '.join(parts)}) SELECT scale, lang, source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM u GROUP BY 1, 2, 3"


SHARES = (0.1, 0.25, 0.5)


@query(_allocation_sql(SHARES))
def nested_scales(spark, sf):
    """Nested samples of exact sizes from strata of language and source, and what each stratum gives."""
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source")
    n = d.count()
    out = selection.nested_scales(d, ["lang", "source"], "doc_id", 5, [int(n * x) for x in SHARES])
    return out.groupBy("scale", "lang", "source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""WITH RECURSIVE c AS (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'H1' END, CASE WHEN c_nationkey % 3 = 0 THEN 'L1' END, CASE WHEN c_custkey % 5 = 0 THEN 'V1' END], lambda x: x IS NOT NULL) AS need, row_number() OVER (ORDER BY sha256('1:' || c_custkey)) AS i FROM customer),
s AS (SELECT s_suppkey, list_filter([CASE WHEN s_suppkey % 3 > 0 THEN 'H1' END, CASE WHEN s_nationkey % 2 = 0 THEN 'L1' END, CASE WHEN s_suppkey % 4 = 0 THEN 'V1' END], lambda x: x IS NOT NULL) AS has, sha256('2:' || s_suppkey) AS o FROM supplier),
m(i, c_custkey, s_suppkey, used) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] UNION ALL
  SELECT i, c_custkey, hit, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END FROM (
    SELECT c.i, c.c_custkey::BIGINT AS c_custkey, m.used, (SELECT arg_min(s.s_suppkey::BIGINT, s.o) FROM s WHERE list_has_all(s.has, c.need) AND NOT list_contains(m.used, s.s_suppkey)) AS hit FROM m JOIN c ON c.i = m.i + 1))
SELECT c_custkey, s_suppkey FROM m WHERE s_suppkey IS NOT NULL""")
def one_use_pairs(spark, sf):
    """Customers, in the order of a hash, take suppliers that have all they need; each supplier is taken once."""
    some = lambda **bits: F.array_compact(F.array(*[F.when(c, k) for k, c in bits.items()]))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    left = _t(spark, sf, "customer").select(c.cast("bigint").alias("name"), some(H1=c % 2 == 0, L1=F.col("c_nationkey") % 3 == 0, V1=c % 5 == 0).alias("need"))
    right = _t(spark, sf, "supplier").select(s.cast("bigint").alias("name"), some(H1=s % 3 > 0, L1=F.col("s_nationkey") % 2 == 0, V1=s % 4 == 0).alias("has"))
    out = matching.one_use_match(spark, left, right, C.seeded_hash(1, F.col("name").cast("string")), C.seeded_hash(2, F.col("name").cast("string")))
    return out.select(F.col("name").alias("c_custkey"), F.col("match").alias("s_suppkey"))


@query(f"""WITH {EV}, c AS (SELECT event_type, us // 3600000000 AS h, count(*) AS n FROM ev GROUP BY 1, 2),
a AS (SELECT *, h - row_number() OVER (PARTITION BY event_type ORDER BY h) AS g FROM c WHERE n >= 2)
SELECT event_type, min(h) AS first, max(h) AS last, count(*) AS length, arg_max(h, (n, -h)) AS peak, max(n)::DOUBLE AS peak_value FROM a GROUP BY event_type, g HAVING count(*) >= 2""")
def profile_runs(spark, sf):
    """Hourly counts of each event type as one array a day, and the busy runs in them, which days don't cut."""
    e = _events(spark, sf).groupBy("event_type", F.floor(F.col("us") / (HOUR * MICRO)).alias("h")).agg(F.count("*").alias("n"))
    day = e.groupBy("event_type", F.floor(F.col("h") / 24).alias("day")).agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("of"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.col("of")[F.col("day") * 24 + i], F.lit(0)))
    return profiles.profile_runs(day.select("event_type", (F.col("day") * 24).alias("start"), hours.alias("n")), ["event_type"], "start", "n", 2, 2)


@query("""WITH RECURSIVE k AS (SELECT o_custkey % 500 AS name, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2),
l AS (SELECT label, sum(n) AS total, row_number() OVER (ORDER BY label) AS pos FROM k GROUP BY 1),
f AS (SELECT * FROM (VALUES ('test', 0.2::DOUBLE), ('train', 0.6::DOUBLE), ('val', 0.2::DOUBLE)) AS t(split, share)),
g AS (SELECT split, list(share * total ORDER BY pos) AS goal FROM f CROSS JOIN l GROUP BY 1),
v AS (SELECT name, list(coalesce(n, 0)::DOUBLE ORDER BY pos) AS x, row_number() OVER (ORDER BY sum(coalesce(n, 0)) DESC, name) AS i FROM (SELECT DISTINCT name FROM k) CROSS JOIN l LEFT JOIN k USING (name, label) GROUP BY 1),
w(i, name, split, have) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, map_from_entries(list((split, list_transform(goal, lambda y: 0::DOUBLE)))) FROM g UNION ALL
  SELECT i, name, best, map_from_entries(list_transform(map_entries(have), lambda e: {'key': e.key, 'value': CASE WHEN e.key = best THEN list_transform(e.value, lambda y, j: y + x[j]) ELSE e.value END})) FROM (
    SELECT v.i, v.name::BIGINT AS name, v.x, w.have, (SELECT arg_min(g.split, (round(list_sum(list_transform(g.goal, lambda y, j: pow((w.have[g.split][j] + v.x[j] - y) / greatest(1, y), 2) - pow((w.have[g.split][j] - y) / greatest(1, y), 2))), 12), g.split)) FROM g) AS best
    FROM w JOIN v ON v.i = w.i + 1))
SELECT name, split FROM w WHERE name IS NOT NULL""")
def balanced_split(spark, sf):
    """Groups of orders, largest first, into splits whose shares of each priority stay near their goals."""
    k = _t(spark, sf, "orders").groupBy((F.col("o_custkey") % 500).cast("bigint").alias("name"), F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return matching.balanced_split(spark, k, {"train": 0.6, "val": 0.2, "test": 0.2})


@query("""WITH h AS (SELECT lang, count(*) AS have FROM documents WHERE lang IS NOT NULL GROUP BY 1 UNION ALL SELECT 'xx', 0)
SELECT lang, have, greatest(0, 60 - have) AS deficit FROM h""")
def label_deficits(spark, sf):
    """How many documents each language lacks of sixty, one that none has among them."""
    return selection.label_deficits(_t(spark, sf, "documents"), "lang", 60, ["xx"])


@query("""WITH d AS (SELECT p_partkey, p_size / 10.0 AS duration, 10 + p_retailprice % 40 AS frequency, 1.0 + p_size % 8 AS quality, CASE p_partkey % 3 WHEN 0 THEN 'H1' WHEN 1 THEN 'L1' ELSE 'V1' END AS ifo FROM part),
g AS (SELECT p_partkey, ifo, greatest(1, count(*) FILTER (WHERE abs(i * 0.5 - 4) <= least(greatest(duration / 2, 0.5), 4.0))) AS wide FROM d CROSS JOIN (SELECT unnest(range(0, 16)) AS i) GROUP BY 1, 2),
f AS (SELECT p_partkey, count(*) FILTER (WHERE abs(i * 5.0 + 10 - frequency) <= greatest(5.0, frequency / quality)) AS high FROM d CROSS JOIN (SELECT unnest(range(0, 9)) AS i) GROUP BY 1)
SELECT p.ifo, x.plane AS detector, sum(CASE WHEN p.ifo = x.plane THEN 2 * wide * high ELSE 0 END)::BIGINT AS marked, count(*) AS triggers FROM g p JOIN f USING (p_partkey) CROSS JOIN (SELECT unnest(['H1', 'L1']) AS plane) x GROUP BY 1, 2""")
def detector_masks(spark, sf):
    """Marked cells of the planes of two detectors at two resolutions, by the detector of the trigger."""
    k = F.col("p_partkey")
    t = _t(spark, sf, "part").select((F.col("p_size") / 10.0).alias("duration"), (10 + F.col("p_retailprice") % 40).cast("double").alias("frequency"), (1.0 + F.col("p_size") % 8).alias("quality"), F.when(k % 3 == 0, "H1").when(k % 3 == 1, "L1").otherwise("V1").alias("ifo"))
    masks = C.weak_masks(F.col("duration"), F.col("frequency"), F.col("quality"), F.col("ifo"), ["H1", "L1"], [8.0, 32.0], 9, 16, 10.0, 50.0, 8.0)
    cells = t.select("ifo", F.posexplode(masks).alias("i", "planes"))
    marked = F.size(F.filter(F.flatten(F.flatten("planes")), lambda x: x == 1))
    return cells.groupBy("ifo", F.element_at(F.array(F.lit("H1"), F.lit("L1")), F.col("i") + 1).alias("detector")).agg(F.sum(marked).alias("marked"), F.count("*").alias("triggers"))


@query(f"""WITH {EV}, x AS (SELECT event_type, us / 1e6 AS t, value, 'gps:' || us // 64000000 * 64 || ':64' AS block FROM ev)
SELECT event_type, count(*) FILTER (WHERE t >= split_part(block, ':', 2)::BIGINT + 24 AND t < split_part(block, ':', 2)::BIGINT + 40) AS central, count(*) FILTER (WHERE event_type NOT IN ('view', 'click') AND value >= 20) AS known,
  count(*) FILTER (WHERE value <= 30 AND t - floor(t / 64) * 64 <= 30) AS gated, round(sum(CASE WHEN value < 20 THEN 20 * pow(5, value / 20) ELSE value END), 3) AS rescaled, round(avg(split_part(block, ':', 3)::BIGINT), 6) AS length FROM x GROUP BY 1""")
def event_contracts(spark, sf):
    """Events in the middle of their block, with a known label, through the timing gate, and with small values drawn anew."""
    e = _events(spark, sf).select("event_type", "value", (F.col("us") / 1e6).alias("t"), C.block_label(C.block_of((F.col("us") / 1e6), 64), 64).alias("block"))
    start, length = C.parse_block(F.col("block"))
    e = e.withColumn("start", start).withColumn("length", length)
    return e.groupBy("event_type").agg(
        F.count_if(C.contains_half_open(F.col("t"), F.col("start") + 32.0, 16.0)).alias("central"),
        F.count_if(C.known_label(F.col("event_type"), F.col("value"), ["view", "click"], 20.0)).alias("known"),
        F.count_if(C.timing_gate(F.col("value"), F.col("t") - F.col("start"), F.lit(0), 30.0)).alias("gated"),
        F.round(F.sum(C.rescale_below(F.col("value"), F.col("value") / 20, 20.0, 100.0)), 3).alias("rescaled"),
        F.round(F.avg("length"), 6).alias("length"),
    )
