"""Streaming = batch: K operators over five parquet files (one per trigger),
compared with their batch twins at the end of input."""

import os

import pytest
from pyspark.sql import functions as F

from loctrack import streaming as K
from loctrack.operators import joins as D
from loctrack.operators import metrics as G
from loctrack.operators import state as C
from loctrack.operators import windows as E
from loctrack.plans import standins as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def few_state_stores(spark):
    """Each micro-batch commits a state store for every shuffle partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _five_files(df, ts_col, out):
    lo, hi = df.agg(F.min(ts_col), F.max(ts_col)).first()
    step = (hi - lo) // 5 + 1
    for i in range(5):
        part = df.filter((F.col(ts_col) >= lo + i * step) & (F.col(ts_col) < lo + (i + 1) * step))
        part.coalesce(1).write.mode("overwrite").parquet(f"{out}/part{i}")
        # one file per folder, read in time order
    files = []
    for i in range(5):
        files += sorted(os.path.join(f"{out}/part{i}", f) for f in os.listdir(f"{out}/part{i}") if f.endswith(".parquet"))
    flat = f"{out}/flat"
    os.makedirs(flat)
    for i, f in enumerate(files):
        os.link(f, f"{flat}/{i:03d}.parquet")
        os.utime(f"{flat}/{i:03d}.parquet", (1_000_000 + i, 1_000_000 + i))
    return flat


def _stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, sdf, name, mode="append"):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode) \
        .option("checkpointLocation", K.stream_checkpoint(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


@pytest.fixture(scope="module")
def upd(spark, tmp_path_factory):
    u = ST.updates(spark, SF)
    path = _five_files(u, "ts_ms", str(tmp_path_factory.mktemp("upd")))
    return u, path


def test_k2_latest_state(spark, upd):
    u, path = upd
    ttl = 24 * 3_600_000
    out = _run(spark, K.latest_state_stream(_stream(spark, u, path), ttl, emit_removals=True), "k2", "update")
    rows = out.collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r.ts_ms, r.change == "remove")):
        last[(r.event_id, r.entity_id)] = r
    latest = {(r.event_id, r.entity_id): r for r in C.latest_locations(u).collect()}
    wm = max(r.ts_ms for r in latest.values()) - 1000
    assert set(last) == set(latest)
    n_removed = 0
    for k, r in last.items():
        assert r.ts_ms == latest[k].ts_ms and r.seq == latest[k].seq
        if r.change == "remove":
            n_removed += 1
            assert r.ts_ms + ttl < wm
    assert n_removed > 0
    # every key still live at the end (not past ts + ttl) is an upsert, not removed
    assert all(last[k].change == "upsert" for k, r in latest.items() if r.ts_ms + ttl >= wm)


def test_k3_group_within(spark, tmp_path_factory):
    s = D.viewer_stream(ST.updates(spark, SF), ST.viewers(spark, SF), 24 * 3_600_000, 6 * 3_600_000, ST.ORIGIN_MS)
    rows = s.select(F.col("viewer_id").cast("string").alias("viewer_id"), "msg_no", "deliver_ms")
    path = _five_files(rows, "deliver_ms", str(tmp_path_factory.mktemp("k3")))
    iv = 6 * 3_600_000
    got = _run(spark, K.group_within_stream(_stream(spark, rows, path), "viewer_id", 3, iv, ts="deliver_ms"), "k3")
    got = {(r.key, r.group_no): (r.group_open_ms, r.n_rows, r.first_msg, r.last_msg) for r in got.collect()}
    b = E.group_within(rows, "viewer_id", 3, iv, ts="deliver_ms", order=["msg_no"])
    want = b.groupBy("viewer_id", "group_no").agg(F.min("group_open_ms").alias("o"), F.count(F.lit(1)).alias("n"),
                                                  F.min("msg_no").alias("f"), F.max("msg_no").alias("l")).collect()
    wm = rows.agg(F.max("deliver_ms")).first()[0] - 1000
    want = {(r.viewer_id, r.group_no): (r.o, r.n, r.f, r.l) for r in want}
    closed = {k: v for k, v in want.items() if v[1] == 3 or v[0] + iv < wm
              or (k[0], k[1] + 1) in want}
    assert got == closed


def test_k4_k7_k5(spark, upd, tmp_path_factory):
    u, path = upd
    v = ST.viewers(spark, SF)
    fo = _run(spark, K.fan_out_stream(_stream(spark, u, path), v), "k4")
    assert sorted(map(tuple, fo.collect())) == sorted(map(tuple, D.fan_out(u, v).collect()))

    rate = _run(spark, K.publish_rate_stream(_stream(spark, u, path), 3_600_000), "k7")
    wm = u.agg(F.max("ts_ms")).first()[0] - 1000
    want = {(r.event_id, r.window_ms): r.n_updates for r in G.publish_rate(u, 3_600_000).collect()
            if r.window_ms + 3_600_000 <= wm}
    assert {(r.event_id, r.window_ms): r.n_updates for r in rate.collect()} == want

    acc = ST.accesses(spark, SF)
    apath = _five_files(acc, "access_ms", str(tmp_path_factory.mktemp("k5")))
    ttl = 3_600_000
    ses = _run(spark, K.channel_sessions_stream(_stream(spark, acc, apath), ttl), "k5")
    awm = acc.agg(F.max("access_ms")).first()[0] - 1000
    batch = {(r.event_id, r.started_ms, r.last_access_ms, r.n_accesses)
             for r in C.channel_sessions(acc, ttl, None).collect() if r.removed_at_ms <= awm}
    assert {(r.event_id, r.started_ms, r.last_access_ms, r.n_accesses) for r in ses.collect()} == batch


def test_k1_k6_foreach_batch(spark, tmp_path_factory):
    raw = ST.raw_requests(spark, SF)
    base = str(tmp_path_factory.mktemp("k1"))
    path = _five_files(raw, "received_ms", base)
    q = K.ingest_stream(_stream(spark, raw, path), f"{base}/acc", f"{base}/rej", K.stream_checkpoint(spark, "k1"))
    q.awaitTermination(300)
    from loctrack.operators import validate as V
    acc, rej = V.split_valid(V.validate_updates(raw))
    assert spark.read.parquet(f"{base}/acc").count() == acc.count()
    assert spark.read.parquet(f"{base}/rej").count() == rej.count()

    u = ST.updates(spark, SF)
    upath = _five_files(u, "ts_ms", str(tmp_path_factory.mktemp("k6")))
    q = K.newest_n_stream(_stream(spark, u, upath), 5, f"{base}/kept", f"{base}/dropped",
                          K.stream_checkpoint(spark, "k6"))
    q.awaitTermination(300)
    kept = spark.read.parquet(f"{base}/kept")
    last = kept.agg(F.max("batch_id")).first()[0]
    cols = ["event_id", "entity_id", "ts_ms", "seq"]
    buffer = kept.filter(F.col("batch_id") == last)
    # the buffer outlives the triggers: it holds the newest rows of the whole input
    assert sorted(map(tuple, buffer.select(cols).collect())) == sorted(map(tuple, E.newest_n(u, 5).select(cols).collect()))
    dropped = spark.read.parquet(f"{base}/dropped/*")
    assert buffer.count() + dropped.agg(F.sum("n_dropped")).first()[0] == u.count()


def _files(spark, rows, schema, out):
    """One file, and so one micro-batch, for each list of rows."""
    os.makedirs(f"{out}/flat")
    for i, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{out}/b{i}")
        f = next(x for x in os.listdir(f"{out}/b{i}") if x.endswith(".parquet"))
        os.link(f"{out}/b{i}/{f}", f"{out}/flat/{i:03d}.parquet")
        os.utime(f"{out}/flat/{i:03d}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/flat")


def test_k2_late_rows_and_return_after_expiry(spark, tmp_path):
    schema = "event_id string, entity_id string, longitude double, latitude double, ts_ms long, seq long"
    row = lambda ent, ts, seq: ("e", ent, float(seq), 0.0, ts, seq)
    batches = [[row("a", 1_000, 1)], [row("b", 100_000, 2)], [row("b", 110_000, 3)],
               [row("c", 50_000, 4), row("a", 60_000, 5), row("b", 111_000, 6)],  # late: c and a
               [row("a", 120_000, 7), row("b", 110_500, 8)], [row("d", 200_000, 9)], [row("d", 201_000, 10)]]
    out = K.latest_state_stream(_files(spark, batches, schema, str(tmp_path)), 30_000, emit_removals=True)
    got = [(r.entity_id, r.ts_ms, r.change) for r in _run(spark, out, "k2late", "update").collect()]
    assert ("a", 1_000, "remove") in got and ("a", 120_000, "upsert") in got and ("a", 120_000, "remove") in got
    assert not [g for g in got if g[0] == "c" or g[1] == 60_000]
    assert [g for g in got if g[0] == "b" and g[2] == "upsert"] == [("b", 100_000, "upsert"), ("b", 110_000, "upsert"), ("b", 111_000, "upsert")]
    assert ("b", 111_000, "remove") in got and ("d", 201_000, "upsert") in got
    assert not [g for g in got if g[0] == "d" and g[2] == "remove"]


def test_k3_late_rows_numbers_and_freed_state(spark, tmp_path):
    schema = "k string, msg_no long, ts_ms long"
    batches = [[("v", 0, 1_000), ("v", 1, 1_100)], [("w", 0, 50_000)], [("w", 1, 51_000)],  # v times out
               [("v", 2, 52_000), ("v", 9, 5_000), ("x", 0, 300)],                          # 9 and x are late
               [("v", 3, 52_500), ("v", 4, 52_600), ("v", 5, 52_700)],                      # group of 3, then an empty open group
               [("w", 2, 500_000)], [("w", 3, 501_000)], [("v", 6, 502_000)], [("w", 4, 900_000)], [("w", 5, 901_000)]]
    read = lambda name: _files(spark, batches, schema, f"{tmp_path}/{name}")
    kept = _run(spark, K.group_within_stream(read("a"), "k", 3, 5_000, keep_ms=10_000_000), "k3kept").collect()
    v = sorted((r.group_no, r.group_open_ms, r.n_rows, r.first_msg, r.last_msg) for r in kept if r.key == "v")
    assert v == [(0, 1_000, 2, 0, 1), (1, 52_000, 3, 2, 4), (2, 52_700, 1, 5, 5), (3, 502_000, 1, 6, 6)]
    assert not [r for r in kept if r.key == "x"]
    freed = _run(spark, K.group_within_stream(read("b"), "k", 3, 5_000, keep_ms=60_000), "k3freed").collect()
    assert sorted((r.group_no, r.group_open_ms) for r in freed if r.key == "v") == [(0, 1_000), (0, 502_000), (1, 52_000), (2, 52_700)]


def _two_streams(spark, left, left_t, right, right_t, out, slices=5):
    """Both tables in the same time slices, one file of each per trigger."""
    lo, hi = T0, max(left.agg(F.max(left_t)).first()[0], right.agg(F.max(right_t)).first()[0])
    step = (hi - lo) // slices + 1
    for name, df, t in (("l", left, left_t), ("r", right, right_t)):
        for i in range(slices):
            df.filter((F.col(t) >= lo + i * step) & (F.col(t) < lo + (i + 1) * step)).coalesce(1).write.mode("append").parquet(f"{out}/{name}")
    return _stream(spark, left, f"{out}/l"), _stream(spark, right, f"{out}/r")


# Streams begin with the watermark at 0, so rows of the first bucket of 1970 would be late.
T0 = 70_000_000
UPD = "event_id string, entity_id string, longitude double, latitude double, ts_ms long, seq long"
VIEW = "viewer_id long, event_id string, subscribed_ms long, left_ms long, announced_ms long"


def test_k4_viewers_come_and_go(spark, tmp_path):
    """Viewers announced late, leaving early, open-ended, before and after all updates."""
    import random
    rnd = random.Random(3)
    u = spark.createDataFrame([(f"e{rnd.randrange(3)}", f"p{rnd.randrange(9)}", 0.0, 0.0, T0 + rnd.randrange(100_000), i) for i in range(400)], UPD)
    rows = []
    for i in range(40):
        at = T0 + rnd.randrange(90_000)
        rows.append((i, f"e{rnd.randrange(4)}", at, rnd.choice([None, at, at + 1, at + 5_000, at + 50_000]), at + rnd.choice([0, 0, 9_000])))
    v = spark.createDataFrame(rows, VIEW)
    us, vs = _two_streams(spark, u, "ts_ms", v, "announced_ms", str(tmp_path))
    out = _run(spark, K.fan_out_streams(us, vs.drop("announced_ms"), late_ms=9_000, bucket_ms=7_000, open_ms=200_000), "k4_streams")
    want = D.fan_out(u, v)
    key = lambda df: sorted((r.viewer_id, r.seq) for r in df.collect())
    assert key(out) == key(want) and len(key(want)) > 500


def test_k4_state_is_freed(spark, tmp_path):
    """Seats and updates of passed buckets leave the state."""
    u = spark.createDataFrame([("e", f"p{i % 5}", 0.0, 0.0, T0 + i * 100, i) for i in range(2000)], UPD)
    v = spark.createDataFrame([(i, "e", T0 + i * 1000, T0 + i * 1000 + 3000, T0 + i * 1000) for i in range(200)], VIEW)
    us, vs = _two_streams(spark, u, "ts_ms", v, "announced_ms", str(tmp_path), slices=10)
    q = K.fan_out_streams(us, vs.drop("announced_ms"), late_ms=1000, bucket_ms=2000).writeStream.format("memory").queryName("k4_state") \
        .option("checkpointLocation", K.stream_checkpoint(spark, "k4_state")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert spark.table("k4_state").count() == D.fan_out(u, v).count()
    assert max(held) < 1200 and held[-1] < 400  # all rows of both sides would be over 2,400


def test_k2_stays_end_at_sweeps(spark, tmp_path):
    """Rows out of order within the watermark; equal to C6 for closed sweeps."""
    import random
    rnd = random.Random(5)
    ttl, sweep = 3_000, 2_000
    rows = [("e", f"p{rnd.randrange(12)}", 0.0, 0.0, rnd.randrange(60_000), i) for i in range(250)] + [("e", "edge", 0.0, 0.0, t, 1000 + t) for t in (1_000, 4_000, 8_000, 12_001)]
    u = spark.createDataFrame(rows, UPD).withColumn("arrives", F.col("ts_ms") + F.pmod(F.xxhash64("seq"), F.lit(4_000)))
    lo, hi = 0, 64_000
    for i in range(6):
        u.filter((F.col("arrives") >= lo + i * hi // 6) & (F.col("arrives") < lo + (i + 1) * hi // 6)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = _stream(spark, u, f"{tmp_path}/in").drop("arrives")
    out = _run(spark, K.lifetimes_stream(s, ttl, sweep, 0, watermark_ms=4_000), "k2_sweeps")
    closed = u.agg(F.max("ts_ms")).first()[0] - 4_000
    got = {r.removed_at_ms: r["count"] for r in out.groupBy("removed_at_ms").count().collect()}
    want = {r.sweep_ms: r.n_removed for r in C.removal_log(u.drop("arrives"), ttl, sweep, 0).filter(F.col("sweep_ms") <= closed).collect()}
    assert got == want and len(want) > 10
    edge = sorted((r.entered_ms, r.removed_at_ms, r.n_updates) for r in out.filter("entity_id = 'edge'").collect())
    assert edge == [(1_000, 12_000, 3), (12_001, 16_000, 1)]  # an update on the very sweep comes in time


def test_k3_by_windows(spark, upd):
    u, path = upd
    keyed = u.select("event_id", "ts_ms", "seq")
    out = _run(spark, K.batch_grid_stream(_stream(spark, u, path), "event_id", 3, 3_600_000, "ts_ms", ["ts_ms", "seq"]), "k3_grid")
    g = E.batch_grid(keyed, "event_id", "ts_ms", 3, 3_600_000)
    end = u.agg(F.max("ts_ms")).first()[0] - 1000
    want = g.filter(F.col("window_ms") + 3_600_000 <= end).groupBy("event_id", "window_ms", "batch_no").agg(F.count("*").alias("n"), F.min(F.struct("ts_ms", "seq")).alias("a"), F.max(F.struct("ts_ms", "seq")).alias("b"))
    got = sorted((r.event_id, r.window_ms, r.batch_no, r.n_rows, tuple(r.first), tuple(r.last)) for r in out.select("event_id", "window_ms", "batch_no", "n_rows", "first", "last").collect())
    assert got == sorted((r.event_id, r.window_ms, r.batch_no, r.n, tuple(r.a), tuple(r.b)) for r in want.collect())
