"""Stored snapshot, bucketed tables, interval index, event pairs and sketches."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loctrack.operators import joins as D
from loctrack.operators import sketches as SK
from loctrack.operators import state as C
from loctrack.operators import stored as S

UPD = "event_id string, entity_id string, longitude double, latitude double, ts_ms long, seq long"
COLS = ["event_id", "entity_id", "longitude", "latitude", "ts_ms", "seq"]


def _rows(seed, n, events=6, entities=20, span=100_000):
    rnd = random.Random(seed)
    return [(rnd.choice([f"e{i}" for i in range(events)]), f"p{rnd.randrange(entities)}", rnd.uniform(-180, 180), 1.0, rnd.randrange(span), i) for i in range(n)]


def _sorted(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or COLS)).collect()), key=repr)


@pytest.fixture()
def store(spark, tmp_path):
    return S.StoredSnapshot(spark, f"file://{tmp_path}/snap", cells=8, spread=2)


def test_upserts_equal_the_whole_history(spark, store):
    rows = _rows(1, 600) + [(None, "p1", 0.0, 0.0, 5, 9000), ("e1", None, 0.0, 0.0, 5, 9001), ("e1", "P1", 0.0, 0.0, 5, 9002)]
    random.Random(2).shuffle(rows)
    for k in range(6):
        part = spark.createDataFrame(rows[k * 100 : (k + 1) * 100 if k < 5 else None], UPD)
        assert store.upsert(part, k) > 0
        seen = spark.createDataFrame(rows[: (k + 1) * 100] if k < 5 else rows, UPD)
        assert _sorted(store.read()) == _sorted(C.latest_locations(seen))
    assert _sorted(store.read(["e1", "e3"])) == _sorted(C.latest_locations(spark.createDataFrame(rows, UPD)).filter("event_id in ('e1', 'e3')"))


def test_an_upsert_rewrites_only_the_cells_it_touches(spark, store):
    store.upsert(spark.createDataFrame(_rows(3, 300), UPD), 0)
    before = store.manifest()["cells"]
    assert store.upsert(spark.createDataFrame([("e1", "p1", 0.0, 0.0, 10**9, 10**6)], UPD), 1) == 1
    after = store.manifest()["cells"]
    assert len([c for c in after if after[c] != before.get(c)]) == 1
    opened = {f.rsplit("_cell=", 1)[1].split("/")[0] for f in store.read(["e1"]).inputFiles()}
    assert len(opened) <= 2 < len(after)


def test_a_replayed_batch_changes_nothing(spark, store):
    part = spark.createDataFrame(_rows(4, 50), UPD)
    store.upsert(part, "b1")
    number = store.manifest()["number"]
    assert store.upsert(part, "b1") == 0 and store.manifest()["number"] == number


def test_a_failed_batch_leaves_the_snapshot(spark, store, monkeypatch):
    """A task that fails after some files are written, a driver that dies before
    the manifest, and a second writer."""
    store.upsert(spark.createDataFrame(_rows(5, 200), UPD), 0)
    want, number = _sorted(store.read()), store.manifest()["number"]
    bad = spark.createDataFrame(_rows(6, 50), UPD).withColumn("longitude", F.when(F.col("seq") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("longitude")))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad, 1)
    commit = S.StoredSnapshot._commit
    monkeypatch.setattr(S.StoredSnapshot, "_commit", lambda self, m: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.upsert(spark.createDataFrame(_rows(6, 50), UPD), 1)
    monkeypatch.setattr(S.StoredSnapshot, "_commit", commit)
    assert _sorted(store.read()) == want and store.manifest()["number"] == number
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(store.manifest())
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("e1", "p1", 5)], "event_id string, entity_id string, ts_ms long"), 2)
    assert _sorted(store.read()) == want


def test_old_cells_are_cleaned(spark, store):
    for k in range(3):
        store.upsert(spark.createDataFrame(_rows(20 + k, 60, events=3), UPD), k)
    want = _sorted(store.read())
    assert store.clean() == 0  # written just now
    assert store.clean(keep=1, older_ms=0) > 0 and _sorted(store.read()) == want
    assert store.clean(keep=1, older_ms=0) == 0
    store.upsert(spark.createDataFrame([("e1", "p1", 0.0, 0.0, 10**9, 10**6)], UPD), 3)
    assert store.clean(keep=2, older_ms=0) == 0 and store.clean(keep=1, older_ms=0) == 1


def test_empty_batches(spark, store):
    assert store.read() is None
    assert store.upsert(spark.createDataFrame([], UPD), 0) == 0
    store.upsert(spark.createDataFrame(_rows(7, 20), UPD), 1)
    assert store.upsert(spark.createDataFrame([], UPD), 2) == 0 and store.read().count() > 0


def _plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture()
def shown_buckets(spark):
    """By default Spark prunes buckets without showing it where no join needs them."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    yield
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_bucketed_reads_and_joins(spark, shown_buckets):
    u = spark.createDataFrame(_rows(8, 500, events=40), UPD)
    table = S.write_bucketed(u, "test_updates", 16)
    some = S.events_of(table, ["e3", "e5"])
    assert _sorted(some) == _sorted(u.filter("event_id in ('e3', 'e5')"))
    text = _plan(some)
    assert "SelectedBucketsCount: 2 out of 16" in text or "SelectedBucketsCount: 1 out of 16" in text
    v = spark.createDataFrame([(i, f"e{i % 40}", i * 1000, None if i % 3 else i * 1000 + 40_000) for i in range(60)], "viewer_id long, event_id string, subscribed_ms long, left_ms long")
    left = S.write_bucketed(S.slotted(u, 3, ["entity_id", "seq"]), "test_slots", 16, by="slot")
    right = S.write_bucketed(S.slotted(v, 3), "test_seats", 16, by="slot")
    met = S.fan_out_bucketed(left, right)
    assert "Exchange" not in _plan(met) and "SortMergeJoin" in _plan(met)
    assert _sorted(met, "viewer_id", "seq") == _sorted(D.fan_out(u, v), "viewer_id", "seq")
    one = S.events_of(left, ["e3"], slots=3)
    assert _sorted(one) == _sorted(u.filter("event_id = 'e3'"))
    assert "out of 16" in _plan(one)


@pytest.mark.parametrize("ttl,sweep", [(30_000, 10_000), (1_000, 7_000), (500, 300)])
def test_interval_index_equals_one_by_one(spark, ttl, sweep):
    u = spark.createDataFrame(_rows(9, 250) + [("e0", "p0", 0.0, 0.0, t, 1000 + t) for t in (0, 1, 1, 2, 50_000)], UPD)
    index = S.IntervalIndex.build(u, ttl, sweep, origin_ms=0)
    times = [0, 1, 2, 999, 6_999, 7_000, 10_000, 33_333, 50_000, 99_999, 10**7]
    found = index.at(spark.createDataFrame([(t,) for t in times] + [(5,), (5,)], "at_ms long"))
    got = {}
    for r in found.collect():
        got.setdefault(r.at_ms, []).append(tuple(r[c] for c in COLS))
    for t in [*times, 5]:
        assert sorted(got.get(t, []), key=repr) == _sorted(C.snapshot_as_of(u, t, ttl, sweep)), t


def test_an_interval_is_in_two_blocks_at_most(spark):
    u = spark.createDataFrame(_rows(10, 400), UPD)
    index = S.IntervalIndex.build(u, 30_000, 10_000)
    per = index.rows.groupBy(*COLS).agg(F.count("*").alias("n"), F.countDistinct("level").alias("l")).agg(F.max("n"), F.max("l")).first()
    assert tuple(per) <= (2, 1) and len(index.levels) <= S.IntervalIndex.LEVELS


def test_fan_out_of_a_hot_event(spark):
    """One event holds 90 % of the updates and of the viewers, and one bucket most of them."""
    rnd = random.Random(13)
    rows = [("hot" if rnd.random() < 0.9 else f"e{rnd.randrange(9)}", f"p{rnd.randrange(50)}", 0.0, 0.0, rnd.randrange(3000) if rnd.random() < 0.8 else rnd.randrange(9000), i) for i in range(6000)]
    u = spark.createDataFrame(rows, UPD)
    v = spark.createDataFrame([(i, "hot" if i % 10 else f"e{i % 9}", rnd.randrange(2000), rnd.choice([None, 5000])) for i in range(40)], "viewer_id long, event_id string, subscribed_ms long, left_ms long")
    plain = D.fan_out(u, v, bucket_ms=1000)
    salted = D.fan_out(u, v, bucket_ms=1000, cell_rows=200, cell_pairs=4000)
    assert _sorted(salted, "viewer_id", "seq", "subscribed_ms") == _sorted(plain, "viewer_id", "seq", "subscribed_ms")
    stream = [_sorted(D.viewer_stream(u, v, 3000, 1000, bucket_ms=1000, number=False, cell_rows=n, cell_pairs=m), "viewer_id", "phase", "seq", "deliver_ms") for n, m in ((10**6, 10**8), (200, 4000))]
    assert stream[0] == stream[1] and {r[1] for r in stream[0]} == {0, 1}
    cells = D._cells(u, 1000)
    hot = D.hot_cells(cells, v, 200, 4000)
    by_event = {(r._hot_ev, r._hot_bucket): r._salts for r in hot.collect()}
    assert {e for e, _ in by_event} == {"hot"}
    dealt = D._salted(u.withColumn("_at", F.floor(F.col("ts_ms") / 1000)), hot, "event_id", "_at", ["entity_id", "seq"])
    sizes = sorted(r["count"] for r in dealt.filter("event_id = 'hot'").groupBy("_at", "_salt").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and sizes[-1] < 300


def _deliveries(spark, lists):
    return spark.createDataFrame([(e, "|".join(ids)) for e, ids in lists], "event_id string, skater_ids string")


def _pairs(lists):
    per = {}
    for e, ids in lists:
        for i in ids:
            if i.strip():
                per.setdefault(i.strip(), set()).add(e)
    return dict(Counter(p for events in per.values() for p in combinations(sorted(events), 2)))


@pytest.mark.parametrize("block", [1000, 7, 1])
def test_event_pairs(spark, block):
    rnd = random.Random(11)
    lists = [(f"e{e:02d}", [f"i{rnd.randrange(30)}" for _ in range(rnd.randrange(6))] + ["everywhere"] + [" "] * (e % 2)) for e in range(25)]
    found = {(r.event_a, r.event_b): r.n_ids for r in D.event_pairs(_deliveries(spark, lists * 2), block).collect()}
    assert found == _pairs(lists)
    assert D.event_pairs(_deliveries(spark, [("a", ["1"]), ("b", ["2"])]), block).count() == 0


def test_ids_of_one_set_of_events_are_one_list(spark):
    """Thousands of ids in every event: pairs are made once, not once for each id."""
    lists = [(f"e{e:02d}", [f"i{k}" for k in range(2000)]) for e in range(12)]
    df = D.event_pairs(_deliveries(spark, lists))
    assert {r.n_ids for r in df.collect()} == {2000} and df.count() == 66


def test_sketches_of_ranges(spark):
    rnd = random.Random(12)
    rows = [(f"e{rnd.randrange(3)}", rnd.randrange(10 * SK.HOUR_MS), f"p{rnd.randrange(4000)}|p{rnd.randrange(4000)}", rnd.choice([None, float("nan"), *[rnd.expovariate(0.01)] * 8])) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "event_id string, receive_ms long, skater_ids string, v double").cache()
    for lo, hi in ((None, None), (2 * SK.HOUR_MS, 5 * SK.HOUR_MS)):
        some = df.filter((F.col("receive_ms") >= (lo or 0)) & (F.col("receive_ms") < (hi or 10**12)))
        est = {r.event_id: r.n_entities for r in SK.seen_entities_from(SK.id_sketches(df), from_ms=lo, to_ms=hi).collect()}
        for r in D.delivered_ids(some).groupBy("event_id").count().collect():
            assert abs(est[r.event_id] - r["count"]) <= 1 + SK.distinct_bound() * r["count"]
        summary = SK.value_summary_from(SK.value_sketches(df, "v", "receive_ms"), from_ms=lo, to_ms=hi)
        exact = {r.event_id: r for r in some.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("event_id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean")).collect()}
        for r in summary.collect():
            e = exact[r.event_id]
            assert (r.n, r.min, r.max) == (e.n, e.lo, e.hi) and r.mean == pytest.approx(e.mean)
        for r in SK.rank_errors(some, "v", summary).collect():
            assert max(r.p50_error, r.p95_error, r.p99_error) <= SK.rank_bound()
