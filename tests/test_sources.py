"""Readers and writers on files written to a fresh temp folder."""

import glob
import os

from pyspark.sql import functions as F

from loctrack import sources as A
from loctrack.operators import logs as I
from loctrack.operators import timeseries as H


def test_publish_csv_round_trip(spark, tmpdir_path):
    ts = 1730030400000  # 2024-10-27T12:00:00Z
    df = spark.createDataFrame([(ts, "event-123", "skater-456", 150000, "")],
                               "ts_ms long, event_id string, skater_id string, response_time_us long, error string")
    out = f"{tmpdir_path}/pub"
    A.write_publish_metrics(df.coalesce(1), out)
    lines = open(glob.glob(f"{out}/*.csv")[0]).read().splitlines()
    assert lines == ["timestamp,event_id,skater_id,response_time_ms,error",
                     "2024-10-27T12:00:00Z,event-123,skater-456,150.00,"]
    back = A.read_publish_metrics(spark, out).collect()[0]
    assert (back.ts_ms, back.response_time_ms, back.error) == (ts, 150.0, "")


def test_delivery_csv(spark, tmpdir_path):
    p = f"{tmpdir_path}/d.csv"
    with open(p, "w") as f:
        f.write("timestamp,event_id,viewer_number,message_count,latency_ms,skater_ids,error\n")
        f.write("2024-01-01T12:00:00Z,test-event,42,10,150.00,skater1|skater2,\n")
        f.write("2024-01-01T12:00:01Z,test-event,42,10,0.00,,failed to parse message: bad\n")
    rows = A.read_delivery_metrics(spark, p).orderBy("ts_ms").collect()
    assert rows[0].skater_id_list == ["skater1", "skater2"] and rows[1].skater_id_list == []
    assert rows[0].viewer_number == 42 and rows[1].error.startswith("failed to parse")
    txt = A.delivery_metrics_text(A.read_delivery_metrics(spark, p)).orderBy("timestamp").collect()[0]
    assert tuple(txt) == ("2024-01-01T12:00:00Z", "test-event", "42", "10", "150.00", "skater1|skater2", "")


def _recording(path, samples, tail=""):
    with open(path, "w") as f:
        for t, heap in samples:
            f.write(f"jdk.GCHeapSummary {{\n  startTime = {t} (2026-01-18)\n  gcId = 1\n"
                    f"  heapSpace = {{\n    start = 0x1\n  }}\n  heapUsed = {heap}\n}}\n\n")
        f.write(tail)


def test_heap_recordings(spark, tmpdir_path):
    d = f"{tmpdir_path}/rec"
    os.makedirs(d)
    _recording(f"{d}/stable.txt", [(f"10:{m:02d}:00.000", "100.0 MB") for m in range(10)],
               tail="jdk.GCHeapSummary {\n  startTime = 10:30:00.000\n  heapUsed = 999.0 MB\n")
    _recording(f"{d}/steep.txt", [(f"11:{m:02d}:00.5", f"{100 + 10 * m}.0 MB") for m in range(10)])
    _recording(f"{d}/midnight.txt", [("23:58:00.000", "1 GB"), ("23:59:00.000", "1048576 KB"),
                                     ("00:00:30.500", "1073741824"), ("00:01:30.000", "1024.0 MB")])
    lines = A.read_heap_recordings(spark, d)
    samples = H.heap_samples(lines)
    el = H.elapsed_seconds(samples)
    got = {os.path.basename(r.recording): r for r in H.recording_summary(el).collect()}
    assert got["stable.txt"].n_samples == 10            # unclosed final block dropped
    assert got["stable.txt"].assessment == "STABLE"
    assert abs(got["steep.txt"].growth_mb_per_min - 10.0) < 1e-9 and got["steep.txt"].assessment == "LEAK"
    mid = sorted((r.sample_no, r.elapsed_s, r.heap_mb) for r in el.collect() if r.recording.endswith("midnight.txt"))
    assert [x[1] for x in mid] == [0.0, 60.0, 150.5, 210.0]
    assert all(abs(x[2] - 1024.0) < 1e-9 for x in mid)


def test_elapsed_index_and_iso(spark):
    df = spark.createDataFrame([("r1", 1, "garbage", 1.0), ("r1", 2, "10:00:00.0", 2.0),
                                ("r2", 1, "2026-01-18T23:59:59.000Z", 1.0), ("r2", 2, "bad", 1.0),
                                ("r2", 3, "2026-01-19T00:00:09.500Z", 1.0)],
                               "recording string, sample_no long, time_str string, heap_mb double")
    got = sorted((r.recording, r.sample_no, r.elapsed_s) for r in H.elapsed_seconds(df).collect())
    assert got == [("r1", 1, 0.0), ("r1", 2, 1.0), ("r2", 1, 0.0), ("r2", 3, 10.5)]


def test_logs(spark, tmpdir_path):
    p = f"{tmpdir_path}/app.log"
    with open(p, "w") as f:
        f.write("2026-01-11 13:42:10 \x1b[34mINFO \x1b[0m \x1b[36mapp.core.CleanupService\x1b[0m  "
                "Cleanup completed: removed 3 locations\n")
        f.write("2026-01-11 13:42:20 INFO  app.core.BroadcasterCleanupService Hub cleanup completed: removed 2 hubs\n")
        f.write("Container killed: exit code 137\n")
        f.write("2026-01-11 13:43:00 INFO  app.Main exit code 0\n")
    logs = A.read_app_logs(spark, p)
    rows = logs.orderBy("line_no").collect()
    assert (rows[0].level, rows[0].logger, rows[0].message) == ("INFO", "app.core.CleanupService",
                                                               "Cleanup completed: removed 3 locations")
    assert rows[2].level is None and rows[2].message == "Container killed: exit code 137"
    crash = [r.crash_reason for r in I.crash_scan(logs).collect()]
    assert crash == ["killed"]
    sw = {r.kind: r.n_removed for r in I.sweep_log(logs).collect()}
    assert sw == {"locations": 3, "hubs": 2}


def test_flat_update_json_cases(spark):
    cases = [
        ('{"eventId":"e","skaterId":"s","longitude":1.5,"latitude":2,"timestamp":123}', None, 123),
        ('{"eventId":"e","skaterId":"s","longitude":1.5,"latitude":2}', None, 777),
        ('{"eventId":"e","skaterId":"s","longitude":1.5,"latitude":2,"timestamp":null}', None, 777),
        ('{"eventId":"e","skaterId":"s","longitude":1e2,"latitude":-0.0,"timestamp":9223372036854775807}', None,
         9223372036854775807),
        ('{"eventId":"e","skaterId":"s","longitude":1.5,"latitude":2,"timestamp":1.5}', "invalid timestamp", None),
        ('{"eventId":"e","skaterId":"s","longitude":1.5,"latitude":2,"timestamp":"x"}', "invalid timestamp", None),
        ('{"eventId":"e","skaterId":"s","longitude":1.5,"latitude":2,"timestamp":true}', "invalid timestamp", None),
        ('{"eventId":null,"skaterId":"s","longitude":1.5,"latitude":2}', "invalid eventId", None),
        ('{"eventId":1,"skaterId":"s","longitude":1.5,"latitude":2}', "invalid eventId", None),
        ('{"eventId":"e","longitude":1.5,"latitude":2}', "invalid skaterId", None),
        ('{"eventId":"e","skaterId":"s","longitude":"1.5","latitude":2}', "invalid longitude", None),
        ("nope", "invalid json", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string")
    got = A.parse_flat_updates(df, "j", now_ms=777).orderBy("i").collect()
    for (txt, err, ts), r in zip(cases, got):
        assert r.decode_error == err, txt
        if err is None:
            assert r.timestamp == ts, txt
    loc = A.parse_locations(spark.createDataFrame([('{"skaterId":"s","latitude":1,"longitude":2}',)], "j string"), "j")
    assert loc.collect()[0].decode_error == "invalid timestamp"


def test_explode_batches_with_bad_message(spark):
    good = '{"locations":[{"skaterId":"a","latitude":1.0,"longitude":2.0,"timestamp":5}],"serverTime":9}'
    df = spark.createDataFrame([(1, good), (2, "{not json")], "n int, m string")
    rows = A.explode_batches(df, "m", keep=["n"]).orderBy("n").collect()
    assert (rows[0].skaterId, rows[0].pos, rows[0].serverTime) == ("a", 0, 9)
    assert rows[1].decode_error == "failed to parse message"
    b = spark.createDataFrame([([("a", 1.0, 2.0, 5)], 9)],
                              "locations array<struct<skaterId:string,latitude:double,longitude:double,timestamp:bigint>>, serverTime bigint")
    assert b.select(A.batches_to_json(b)).first()[0] == good


def test_explode_batches_rejects_mistyped_messages(spark):
    from loctrack import sources as A

    bad = ["[1,2]", '{"locations":[{"skaterId":"a","latitude":"x"}],"serverTime":1}', '{"locations":"no"}',
           '{"locations":[{"skaterId":7}]}', '{"locations":[],"serverTime":"t"}', "null", "7", None, "",
           '{"locations":[7]}', '{"serverTime":1.5}', '{"locations":[{"skaterId":"a"},{"timestamp":true}]}']
    good = ['{"locations":[{"skaterId":"a","latitude":1,"longitude":2.5,"timestamp":3},null],"serverTime":9}', '{"locations":[],"serverTime":1}', "{}"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(bad + good)], "i int, m string")
    rows = A.explode_batches(df, "m", keep=["i"]).collect()
    assert sorted(r.i for r in rows if r.decode_error) == list(range(len(bad)))
    n = len(bad)
    fine = sorted((r.i, r.serverTime, r.pos, r.skaterId, r.latitude, r.longitude, r.timestamp) for r in rows if not r.decode_error and r.i == n)
    assert fine == [(n, 9, 0, "a", 1.0, 2.5, 3), (n, 9, 1, None, None, None, None)]
    assert [(r.serverTime, r.pos) for r in rows if r.i in (n + 1, n + 2)] == [(1, None), (None, None)]


def test_lines_are_numbered_per_file(spark, tmp_path):
    from pyspark.sql import functions as F

    from loctrack import sources as A
    from loctrack.operators import logs as I

    for k in range(3):
        (tmp_path / f"{k}.log").write_text("".join(f"{k} line {i}\n" for i in range(500 * (k + 1))))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        logs = A.read_app_logs(spark, str(tmp_path)).collect()
        tail = I.crash_scan(A.read_app_logs(spark, str(tmp_path)).withColumn("text", F.concat("text", F.lit(" OutOfMemoryError"))), tail=2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(logs) == 3000
    for r in logs:
        assert r.text.endswith(f" line {r.line_no}")
    assert sorted(r.text.split(" OutOf")[0] for r in tail) == sorted(f"{k} line {500 * (k + 1) - j}" for k in range(3) for j in (1, 2))
