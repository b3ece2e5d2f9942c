"""Keyed state: store cases of the reference's specs and closed forms against a
plain replay of the store, its sweeps and the channel registry."""

from collections import defaultdict

from pyspark.sql import functions as F

from loctrack.operators import state as C
from loctrack.plans import standins as ST

U = "event_id string, entity_id string, longitude double, latitude double, ts_ms long, seq long"


def test_store_cases(spark):
    rows = [("e1", "s1", 1.0, 1.0, 10000, 1), ("e1", "s2", 1.0, 1.0, 40000, 2), ("e1", "s3", 1.0, 1.0, 20000, 3),
            ("e1", "s4", 1.0, 1.0, 20001, 4), ("e2", "s1", 2.0, 2.0, 30000, 5), ("e3", "s9", 0.0, 0.0, 100, 6)]
    df = spark.createDataFrame(rows, U)
    kept = {(r.event_id, r.entity_id) for r in C.retain_live(df, 50000, 30000).collect()}
    assert kept == {("e1", "s2"), ("e1", "s4"), ("e2", "s1")}
    # ttl is truncated to whole seconds
    assert C.retain_live(df, 50000, 30999).count() == 3
    _, summ = C.sweep(df, 50000, 30000)
    s = {r.event_id: (r.n_removed, r.emptied) for r in summ.collect()}
    assert s == {"e1": (2, False), "e2": (0, False), "e3": (1, True)}


def test_last_write_wins_and_isolation(spark):
    rows = [("e1", "s1", 1.0, 1.0, 1000, 1), ("e1", "s1", 2.0, 2.0, 2000, 2), ("e2", "s1", 9.0, 9.0, 500, 3)]
    got = {(r.event_id, r.entity_id): r.longitude for r in C.latest_locations(spark.createDataFrame(rows, U)).collect()}
    assert got == {("e1", "s1"): 2.0, ("e2", "s1"): 9.0}
    snap = C.latest_locations(spark.createDataFrame(rows[:1], U))
    up = C.upsert(snap, spark.createDataFrame(rows[1:], U))
    assert {(r.event_id, r.longitude) for r in up.collect()} == {("e1", 2.0), ("e2", 9.0)}


def _replay(rows, ttl, iv, origin, until):
    """Plain store: apply updates in (ts, seq) order, sweep at origin + k*iv;
    updates at a sweep's time arrive before it."""
    ttl = (ttl // 1000) * 1000
    store, removed, presence = {}, defaultdict(int), {}
    rows = sorted(rows, key=lambda r: (r[4], r[5]))
    k, i = 1, 0
    while origin + k * iv <= until:
        s = origin + k * iv
        while i < len(rows) and rows[i][4] <= s:
            ev, ent, lon, lat, ts, seq = rows[i]
            store[(ev, ent)] = (ts, seq)
            i += 1
        for key in [key for key, (ts, _) in store.items() if ts <= s - ttl]:
            del store[key]
            removed[s] += 1
        k += 1
    for ev, ent, lon, lat, ts, seq in rows[i:]:
        if ts <= until:
            store[(ev, ent)] = (ts, seq)
    return store, removed


def test_closed_forms_equal_replay(spark):
    u = ST.updates(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in u.select("event_id", "entity_id", "longitude", "latitude", "ts_ms", "seq").collect()]
    ttl, iv, origin = 24 * 3_600_000, 6 * 3_600_000, ST.ORIGIN_MS
    end = max(r[4] for r in rows) + 3 * ttl
    _, removed = _replay(rows, ttl, iv, origin, end)
    got = {r.sweep_ms: r.n_removed for r in C.removal_log(u, ttl, iv, origin).collect()}
    assert got == dict(removed)
    for at in (ST.SNAPSHOT_AT_MS, ST.SNAPSHOT_AT_MS + 5 * 3_600_000 + 1, origin + 3_600_000):
        # what a reader sees at `at`: the store after sweeps <= at and updates <= at
        store, _ = _replay(rows, ttl, iv, origin, at)
        snap = C.snapshot_as_of(u, at, ttl, iv, origin)
        assert {(r.event_id, r.entity_id): (r.ts_ms, r.seq) for r in snap.collect()} == store


def _channels_replay(acc, ttl, iv, origin, end):
    acc = sorted(acc, key=lambda x: (x[1], x[0]))
    live, sessions = {}, []
    i, k = 0, 1
    while True:
        s = origin + k * iv
        while i < len(acc) and acc[i][1] <= s:
            ev, a = acc[i]
            if ev in live:
                live[ev][1] = a
                live[ev][2] += 1
            else:
                live[ev] = [a, a, 1]
            i += 1
        for ev in [e for e, v in live.items() if v[1] < s - ttl]:
            st, last, n = live.pop(ev)
            sessions.append((ev, st, last, n, s))
        if i >= len(acc) and not live:
            break
        k += 1
    return sorted(sessions)


def test_channel_sessions_equal_replay(spark):
    a = ST.accesses(spark, "/root/testdata/sf0.001")
    acc = [(r.event_id, r.access_ms) for r in a.collect()]
    ttl, iv = 3_600_000, 600_000
    want = _channels_replay(acc, ttl, iv, ST.ORIGIN_MS, None)
    got = sorted((r.event_id, r.started_ms, r.last_access_ms, r.n_accesses, r.removed_at_ms)
                 for r in C.channel_sessions(a, ttl, iv, ST.ORIGIN_MS).collect())
    assert got == want


def test_channel_edges(spark):
    t = 1_000_000
    a = spark.createDataFrame([("h1", t)], "event_id string, access_ms long")
    assert C.idle_channels(a, t + 6000, 5000).count() == 1
    assert C.idle_channels(a, t + 4000, 5000).count() == 0
    assert C.idle_channels(a, t + 5000, 5000).count() == 0   # equality is kept
    five = spark.createDataFrame([(f"h{i}", t) for i in range(5)], "event_id string, access_ms long")
    assert C.idle_channels(five, t + 1001, 1000).count() == 5
    # a gap exactly equal to the ttl stays one session
    g = spark.createDataFrame([("h", 0), ("h", 1000), ("h", 2001)], "event_id string, access_ms long")
    s = sorted((r.started_ms, r.n_accesses) for r in C.channel_sessions(g, 1000, None).collect())
    assert s == [(0, 2), (2001, 1)]


def test_event_presence(spark):
    rows = [("e", "a", 0.0, 0.0, 1000, 1), ("e", "a", 0.0, 0.0, 5000, 2), ("e", "b", 0.0, 0.0, 100_000, 3)]
    df = spark.createDataFrame(rows, U)
    p = sorted((r.present_from_ms, r.removed_at_ms, r.n_updates)
               for r in C.event_presence(df, 30_000, 10_000, 0).collect())
    # a: removed at the first sweep >= 35000 -> 40000; b: >= 130000 -> 130000
    assert p == [(1000, 40000, 2), (100_000, 130_000, 1)]
