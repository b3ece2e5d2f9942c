"""Metric summaries: exact percentiles against numpy with one hot key, histograms."""

import numpy as np
from pyspark.sql import functions as F

from loctrack.operators import metrics as G


def test_exact_percentiles_hot_key(spark):
    rng = np.random.default_rng(7)
    hot = [("hot", float(x)) for x in np.round(rng.exponential(100, 30000), 2)]
    cold = [(f"k{i}", float(x)) for i in range(20) for x in np.round(rng.normal(50, 10, 50), 2)]
    one = [("single", 5.0)]
    df = spark.createDataFrame(hot + cold + one, "k string, v double")
    got = {r.k: r for r in G.value_summary(df, ["k"], "v").collect()}
    for k in ["hot", "k3", "single"]:
        vals = np.array([v for kk, v in hot + cold + one if kk == k])
        for p, name in [(0.5, "p50"), (0.95, "p95"), (0.99, "p99")]:
            assert abs(getattr(got[k], name) - np.quantile(vals, p)) < 1e-9, (k, name)
    # agrees with Spark's own exact percentile
    ref = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", 0.95).alias("p")).collect()}
    assert all(abs(got[k].p95 - ref[k]) < 1e-9 for k in ref)


def test_histogram_and_classes(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (99.0,), (100.0,), (5000.0,)], "x double")
    h = {r.bucket: (r.lower, r.upper, r.n) for r in G.duration_histogram(df, "x", [0, 100, 1000]).collect()}
    assert h == {0: (None, 0.0, 1), 1: (0.0, 100.0, 2), 2: (100.0, 1000.0, 1), 3: (1000.0, None, 1)}
    m = spark.createDataFrame([("e", "connection error: eof"), ("e", ""), ("e", "boom")], "event_id string, error string")
    c = {r.error_class: r.n_errors for r in G.error_classes(m).collect()}
    assert c == {"connection error": 1, "other": 1}
    s = G.error_summary(m).collect()[0]
    assert (s.n_records, s.n_errors) == (3, 2)


def test_expected_count(spark):
    m = spark.createDataFrame([("e", str(i % 5)) for i in range(2900)], "event_id string, skater_id string")
    r = G.expected_count_check(m, 5, 3, 30).collect()[0]
    # 5 entities * 20 per minute * 30 minutes = 3000, delta 300
    assert (r.expected, r.allowed_delta, r.within) == (3000, 300, True)


def test_value_summary_null_keys_nan_and_no_keys(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, 1.0), (None, 3.0), ("a", 1.0), ("a", 2.0), ("a", 5.0), ("a", nan), ("b", -inf), ("b", 7.0), ("b", inf), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in G.value_summary(df, ["k"], "v", counts={"below2": lambda v: v < 2}).collect()}
    assert set(got) == {None, "a", "b"}
    assert (got[None].n, got[None].min, got[None].mean, got[None].max, got[None].p50, got[None].below2) == (2, 1.0, 2.0, 3.0, 2.0, 1)
    assert got["a"].p50 == 3.5 and np.isnan(got["a"].max) and got["a"].below2 == 1
    assert (got["b"].min, got["b"].p50, got["b"].max) == (-inf, 7.0, inf)
    whole = G.value_summary(df.filter("k = 'a' or k is null"), [], "v").collect()
    assert len(whole) == 1 and whole[0].n == 6 and whole[0].p50 == 2.5
    assert G.value_summary(df.limit(0), ["k"], "v").count() == 0
    approx = {r.k: r for r in G.value_summary(df, ["k"], "v", exact=False).collect()}
    assert approx[None].n == 2


def test_tolerance_is_exact(spark):
    m = spark.createDataFrame([("e", str(i % 5)) for i in range(10)], "event_id string, skater_id string")
    r = G.expected_count_check(m, 5, 3, 10, tol=0.125).collect()[0]
    assert (r.expected, r.allowed_delta) == (1000, 125)


def test_delivery_ties_do_not_multiply(spark):
    u = spark.createDataFrame([("e", "s", 5, 1), ("e", "s", 5, 2), ("e", "s", 6, 3)], "event_id string, entity_id string, ts_ms long, seq long")
    d = spark.createDataFrame([("v", "e", "s", 5, 10, 0), ("v", "e", "s", 5, 10, 1), ("v", "e", "s", 6, 10, 2)],
                              "viewer_id string, event_id string, entity_id string, ts_ms long, serverTime long, pos int")
    assert sorted((r.seq, r.delay_ms) for r in G.publish_to_delivery(u, d).collect()) == [(1, 5), (2, 5), (3, 4)]
