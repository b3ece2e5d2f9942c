"""Fan-out, snapshot-then-live streams, batching and buffers."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loctrack.operators import joins as D
from loctrack.operators import windows as E
from loctrack.operators.sequence import Running, sequence_features
from loctrack.plans import standins as ST

U = "event_id string, entity_id string, longitude double, latitude double, ts_ms long, seq long"
VW = "viewer_id long, event_id string, subscribed_ms long, left_ms long"


def test_fan_out_two_viewers_and_isolation(spark):
    u = spark.createDataFrame([("e1", "s1", 1.0, 1.0, 10, 1), ("e1", "s2", 1.0, 1.0, 20, 2),
                               ("e2", "s3", 1.0, 1.0, 30, 3)], U)
    v = spark.createDataFrame([(1, "e1", 5, None), (2, "e1", 5, None), (3, "e2", 5, None), (4, "e1", 15, 19)], VW)
    got = sorted((r.viewer_id, r.entity_id) for r in D.fan_out(u, v).collect())
    assert got == [(1, "s1"), (1, "s2"), (2, "s1"), (2, "s2"), (3, "s3")]


def test_snapshot_then_live_one_batch(spark):
    # store holds skater-1 @1000 and skater-2 @2000, then skater-3 arrives live @3000
    u = spark.createDataFrame([("e", "skater-1", 1.0, 1.0, 1000, 1), ("e", "skater-2", 2.0, 2.0, 2000, 2),
                               ("e", "skater-3", 3.0, 3.0, 3000, 3)], U)
    v = spark.createDataFrame([(1, "e", 2500, None)], VW)
    s = D.viewer_stream(u, v, 30_000, 10_000, 0)
    rows = sorted((r.msg_no, r.phase, r.entity_id) for r in s.collect())
    assert rows == [(1, 0, "skater-1"), (2, 0, "skater-2"), (3, 1, "skater-3")]
    g = E.batch_grid(s, "viewer_id", "deliver_ms", 100, 10_000, 0, ["phase", "ts_ms", "seq"])
    b = E.to_batches(g, "viewer_id", 10_000, ["deliver_ms", "phase", "ts_ms", "seq"]).collect()
    assert len(b) == 1 and [x.skaterId for x in b[0].locations] == ["skater-1", "skater-2", "skater-3"]


def test_late_viewer_and_empty_event(spark):
    u = spark.createDataFrame([("e", "a", 1.0, 1.0, 1000, 1), ("e", "a", 2.0, 2.0, 2000, 2)], U)
    v = spark.createDataFrame([(1, "e", 1500, None), (2, "empty", 0, None)], VW)
    s = D.viewer_stream(u, v, 30_000, 10_000, 0).collect()
    # the late viewer gets the snapshot row at 1000 and the live one; no replay beyond that
    assert sorted((r.viewer_id, r.ts_ms) for r in s) == [(1, 1000), (1, 2000)]


def test_newest_n_buffer(spark):
    u = spark.createDataFrame([("e", f"s{i}", 0.0, 0.0, i, i) for i in range(10)], U)
    kept = sorted(r.ts_ms for r in E.newest_n(u, 2).collect())
    assert kept == [8, 9]
    d = E.dropped_count(u, 2).collect()[0]
    assert (d.n_rows, d.n_dropped) == (10, 8)


def _brute_groups(ts, size, interval):
    out, g, open_t, n = [], -1, None, 0
    for t in ts:
        if open_t is None or n >= size or t - open_t >= interval:
            g, open_t, n = g + 1, t, 0
        n += 1
        out.append(g)
    return out


@pytest.mark.parametrize("chunk_rows,size,interval,position", [
    (65_536, 3, 6 * 3_600_000, None), (3, 3, 6 * 3_600_000, None), (5, 3, 2 * 3_600_000, "msg_no"),
    (4, 4, 3_600_000, None), (7, 2, 12 * 3_600_000, "msg_no")])
def test_group_within_matches_brute_force(spark, chunk_rows, size, interval, position):
    """Small chunks (many chunks and blocks per viewer) exercise the chunk
    functions, their composition and the entry states flowing back down."""
    s = D.viewer_stream(ST.updates(spark, "/root/testdata/sf0.001"), ST.viewers(spark, "/root/testdata/sf0.001"),
                        24 * 3_600_000, 6 * 3_600_000, ST.ORIGIN_MS)
    rows = s.select("viewer_id", "msg_no", "deliver_ms")
    got = E.group_within(rows, "viewer_id", size, interval, ts="deliver_ms", order=["msg_no"],
                         chunk_rows=chunk_rows, time_chunk_ms=3 * 86_400_000, position=position).toPandas()
    assert len(got) == rows.count()
    for vid, pdf in got.groupby("viewer_id"):
        pdf = pdf.sort_values("msg_no")
        t = pdf["deliver_ms"].tolist()
        want = _brute_groups(t, size, interval)
        assert pdf["group_no"].tolist() == want
        opens = {}
        for g, x in zip(want, t):
            opens.setdefault(g, x)
        assert pdf["group_open_ms"].tolist() == [opens[g] for g in want]


# chunk width, and rows above which a (key, chunk) cell is split further:
# the default bound (no split here), a small bound (many hot cells), and one
# chunk per key that only the split cuts up
SPLITS = [(777, None), (777, 37), (None, 100)]


def _chunk(width):
    return F.floor(F.col("event_id") / width) if width else F.lit(0)


@pytest.mark.parametrize("width,max_rows", SPLITS)
def test_sequence_features_match_plain_window(spark, width, max_rows):
    from pyspark.sql import Window
    from loctrack.operators.sequence import MAX_CHUNK_ROWS
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    df = ev.select(F.col("event_type").alias("k"), "event_id", F.col("value"))
    got = sequence_features(df, ["k"], ["event_id"], _chunk(width),
                            prev=["value"], next=["event_id"],
                            running={"cnt": Running(F.lit(1), "sum"), "mx": Running(F.col("value"), "max", False)},
                            max_chunk_rows=max_rows or MAX_CHUNK_ROWS)
    w = Window.partitionBy("k").orderBy("event_id")
    want = df.select("k", "event_id", F.lag("value").over(w).alias("prev_value"),
                     F.lead("event_id").over(w).alias("next_event_id"),
                     F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cnt"),
                     F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mx"))
    cols = ["k", "event_id", "prev_value", "next_event_id", "cnt", "mx"]
    a = got.select(*cols).toPandas().sort_values("event_id").reset_index(drop=True)
    b = want.select(*cols).toPandas().sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_number_messages_and_resume(spark):
    d = spark.createDataFrame([("e", 1, 1000, "", 1), ("e", 1, 2000, "failed to parse message: x", 2),
                               ("e", 1, 3000, "", 3), ("e", 1, 90_000, "", 4)],
                              "event_id string, viewer_number int, receive_ms long, error string, seq long")
    got = [r.message_count for r in E.number_messages(d).orderBy("seq").collect()]
    assert got == [1, 1, 2, 3]
    r = E.resume_check(d, 60_000).collect()
    assert [(x.silent_from_ms, x.resumed_ms) for x in r] == [(3000, 90_000)]


@pytest.mark.parametrize("width,max_rows", SPLITS)
def test_running_flag_count_matches_plain_window(spark, width, max_rows):
    from pyspark.sql import Window
    from loctrack.operators.sequence import MAX_CHUNK_ROWS, running_flag_count
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    df = ev.select(F.col("event_type").alias("k"), "event_id", "value")
    got = running_flag_count(df, ["k"], ["event_id"], _chunk(width), ["value"],
                             lambda p, c: p.isNull() | (c["value"] > p["value"] + 100), "n", keep_prev=True,
                             max_chunk_rows=max_rows or MAX_CHUNK_ROWS)
    w = Window.partitionBy("k").orderBy("event_id")
    prev = F.lag("value").over(w)
    want = df.withColumn("prev_value", prev).withColumn(
        "f", (F.col("prev_value").isNull() | (F.col("value") > F.col("prev_value") + 100)).cast("long")) \
        .withColumn("n", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["k", "event_id", "prev_value", "n"]
    a = got.select(*cols).toPandas().sort_values("event_id").reset_index(drop=True)
    b = want.select(*cols).toPandas().sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_batch_grid_position_equals_sorted_path(spark):
    """The msg_no shortcut gives the same batches as the chunked window positions."""
    d = "/root/testdata/sf0.001"
    s = D.viewer_stream(ST.updates(spark, d), ST.viewers(spark, d), 24 * 3_600_000, 6 * 3_600_000, ST.ORIGIN_MS)
    order = ["phase", "ts_ms", "seq", "entity_id"]
    a = E.batch_grid(s, "viewer_id", "deliver_ms", 3, 6 * 3_600_000, ST.ORIGIN_MS, order)
    b = E.batch_grid(s, "viewer_id", "deliver_ms", 3, 6 * 3_600_000, ST.ORIGIN_MS, order, position="msg_no")
    cols = ["viewer_id", "msg_no", "window_ms", "batch_no"]
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_a_cell_of_one_time_is_cut(spark):
    """All rows of a key share one time: the other order columns cut the cell."""
    from loctrack.operators.sequence import split_hot_chunks

    n, bound = 20_000, 1_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.lit(5).cast("long").alias("ts_ms"), F.col("id").alias("seq"))
    cells = split_hot_chunks(df, ["k"], ["ts_ms", "seq"], F.lit(0), bound).groupBy("k", "_chunk").count().collect()
    assert len(cells) > n // bound and max(r["count"] for r in cells) <= bound
    got = sequence_features(df, ["k"], ["ts_ms", "seq"], F.lit(0), prev=["seq"], running={"n": Running(F.lit(1), "sum")}, max_chunk_rows=bound)
    assert got.filter((F.col("n") != F.col("seq") + 1) | ~F.col("prev_seq").eqNullSafe(F.when(F.col("seq") > 0, F.col("seq") - 1))).count() == 0


@pytest.mark.parametrize("ttl,sweep,origin,bucket", [(3000, 700, 0, 500), (3000, 700, 20_000, 1000), (2000, 5000, 8000, 100), (90_000, 10_000, 0, 3_600_000)])
def test_buckets_lose_no_pair(spark, ttl, sweep, origin, bucket):
    """Fan-out, snapshots and streams against all pairs, with buckets of every width."""
    rnd = random.Random(ttl + bucket)
    ups = [(f"e{rnd.randint(0, 2)}", f"k{rnd.randint(0, 5)}", 1.0, 2.0, rnd.randint(0, 30_000), i) for i in range(200)]
    ups += [("e0", "k0", 1.0, 2.0, 7_000_000, 900), (None, "k0", 1.0, 2.0, 5, 901)]
    vs = [(i, rnd.choice(["e0", "e1", "e2", "none", None]), s, rnd.choice([None, s - 5, s, s + rnd.randint(0, 20_000)]))
          for i, s in enumerate([0, 1, *(rnd.randint(0, 40_000) for _ in range(40))])]
    u = spark.createDataFrame(ups, "event_id string, entity_id string, longitude double, latitude double, ts_ms long, seq long")
    v = spark.createDataFrame(vs, "viewer_id long, event_id string, subscribed_ms long, left_ms long")
    live = sorted((i, r[5]) for i, ev, s, left in vs for r in ups
                  if r[0] is not None and r[0] == ev and r[4] > s and (left is None or r[4] <= left))
    seen = []
    for i, ev, s, _ in vs:
        newest = {}
        for r in sorted((r for r in ups if r[0] is not None and r[0] == ev and r[4] <= s), key=lambda r: (r[4], r[5])):
            newest[r[1]] = r
        k = (s - origin) // sweep
        seen += [(i, r[5]) for r in newest.values() if k < 1 or r[4] > origin + k * sweep - ttl // 1000 * 1000]
    ids = lambda df: sorted((r.viewer_id, r.seq) for r in df.collect())
    assert ids(D.fan_out(u, v, bucket)) == live
    assert ids(D.snapshot_for_viewers(u, v, ttl, sweep, origin, chunk_ms=9000, bucket_ms=bucket)) == sorted(seen)
    stream = D.viewer_stream(u, v, ttl, sweep, origin, 9000, bucket_ms=bucket)
    assert sorted((r.viewer_id, r.phase, r.seq) for r in stream.collect()) == sorted([(i, 0, q) for i, q in seen] + [(i, 1, q) for i, q in live])
    assert live and seen


@pytest.mark.parametrize("seed", range(5))
def test_chunk_functions_against_a_walk(seed):
    from loctrack.operators import grouping as G
    rnd = random.Random(seed)
    size, interval, n_own = rnd.randint(1, 6), rnd.randint(1, 40), rnd.choice([1, 3, 50, 300])
    t = np.cumsum([rnd.choice([0, 0, 1, 5, 60]) for _ in range(n_own + rnd.randint(0, size - 1))])
    nxt = G.next_open(t, n_own, size, interval)
    got = G.chunk_function(t, n_own, size, interval)
    for e in range(size):
        s, opened = e, []
        while s < n_own:
            opened.append(s)
            s = int(nxt[s])
        assert [int(x[e]) for x in got] == [s - n_own, len(opened), int(t[opened[-1]]) if opened else G.NONE]
        assert np.flatnonzero(G.opening_rows(nxt, e, size)).tolist() == opened
