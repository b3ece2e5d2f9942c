"""Registered queries over stored state, sketches, interval joins and two streams,
and over decoders' reject paths; registered beside those of ``catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loctrack.operators import joins as D
from loctrack.operators import sketches as SK
from loctrack.operators import stored as S
from loctrack.operators import timeseries as H
from loctrack.plans import sqltext as Q
from loctrack.plans import standins as ST
from loctrack.plans.catalog import (
    BATCH_INTERVAL_MS, BATCH_SIZE, END_MS, FANOUT, GRID, LOC_SWEEP_MS, LOC_TTL_MS, VERSIONS, W, _LATEST_SQL, _REPLAY_BATCHES,
    _STREAM_EXTRA, _STREAM_VIEWS, _TTL_S, _WM_MS, _batches, _folder, _replay_rows, _stream, _updates, query,
)
from loctrack.plans.standins import DAY_MS, HOUR_MS, ORIGIN_MS, _uuid_of_type
from loctrack.session import checkpoint_dir
from loctrack.sources import codec as A
from loctrack.sources import files as AF

# ------------------------------------------------------------------- C2, B7, D1, C5 stored
_UPD = ["event_id", "entity_id", "longitude", "latitude", "ts_ms", "seq"]


@query("stored_snapshot", W("updates") + _LATEST_SQL.format(src="updates"))
def q_stored_snapshot(spark, d):
    """C2 kept in a table: the history in time slices, each upserted into the cells
    that it touches."""
    u = _updates(spark, d).select(*_UPD)
    store = S.StoredSnapshot(spark, f"{checkpoint_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex[:12]}", cells=4, spread=2)
    for k in range(_REPLAY_BATCHES):
        lo, hi = (ORIGIN_MS + (30 * DAY_MS * i) // _REPLAY_BATCHES for i in (k, k + 1))
        part = u
        if k:
            part = part.filter(F.col("ts_ms") >= lo)
        if k < _REPLAY_BATCHES - 1:
            part = part.filter(F.col("ts_ms") < hi)
        store.upsert(part, k)
    return store.read()


_TWO = [_uuid_of_type("click"), _uuid_of_type("view")]


@query("events_from_buckets", W("updates") + f"""
SELECT * FROM updates WHERE event_id IN ('{_TWO[0]}', '{_TWO[1]}')""")
def q_events_from_buckets(spark, d):
    """B7 on a table bucketed by event: the scan opens the events' buckets only."""
    table = S.write_bucketed(_updates(spark, d).select(*_UPD), f"updates_{uuid.uuid4().hex}", 16)
    return S.events_of(table, _TWO)


@query("fan_out_bucketed", W("updates", "viewers", extra=[FANOUT]) + "SELECT * FROM fanout")
def q_fan_out_bucketed(spark, d):
    """D1 on two tables bucketed by slot: joined without an exchange."""
    u = S.write_bucketed(S.slotted(_updates(spark, d).select(*_UPD), 4, ["entity_id", "seq"]), f"updates_{uuid.uuid4().hex}", 16, by="slot")
    v = S.write_bucketed(S.slotted(ST.viewers(spark, d), 4), f"viewers_{uuid.uuid4().hex}", 16, by="slot")
    return S.fan_out_bucketed(u, v)


_N_TIMES = 1000
_AT_LAST = Q.floor_div(f"t.at_ms - {ORIGIN_MS}", LOC_SWEEP_MS)


@query("snapshots_at_times", W("updates", extra=[VERSIONS, ("times", f"""
SELECT {ORIGIN_MS} + (i * {30 * DAY_MS}) // {_N_TIMES} AS at_ms FROM (SELECT unnest(range({_N_TIMES})) AS i)""")]) + f"""
SELECT t.at_ms, v.event_id, count(*) AS n_visible, CAST(sum(v.seq) AS BIGINT) AS sum_seq, max(v.ts_ms) AS newest_ms,
  CAST(sum(v.ts_ms - {ORIGIN_MS}) AS BIGINT) AS sum_ms
FROM versions v JOIN times t ON v.ts_ms <= t.at_ms AND (v.next_ts_ms IS NULL OR v.next_ts_ms > t.at_ms)
WHERE {_AT_LAST} < 1 OR v.ts_ms > {ORIGIN_MS} + {_AT_LAST} * {LOC_SWEEP_MS} - {_TTL_S}
GROUP BY t.at_ms, v.event_id""")
def q_snapshots_at_times(spark, d):
    """C5 at 1,000 reader times from one interval index; what each reader sees of
    each event, counted and summed."""
    index = S.IntervalIndex.build(_updates(spark, d).select(*_UPD), LOC_TTL_MS, LOC_SWEEP_MS, ORIGIN_MS)
    seen = index.at(S.reader_times(ORIGIN_MS, END_MS, _N_TIMES, spark))
    return seen.groupBy("at_ms", "event_id").agg(F.count(F.lit(1)).alias("n_visible"), F.sum("seq").alias("sum_seq"), F.max("ts_ms").alias("newest_ms"),
                                                 F.sum(F.col("ts_ms") - F.lit(ORIGIN_MS)).alias("sum_ms"))


# ------------------------------------------------------------------- D5 by pair
@query("event_pairs", W("deliveries") + """
, per AS (SELECT DISTINCT event_id, trim(x) AS entity_id FROM (SELECT event_id, unnest(string_split(skater_ids, '|')) AS x FROM deliveries) WHERE trim(x) <> '')
SELECT a.event_id AS event_a, b.event_id AS event_b, count(*) AS n_ids
FROM per a JOIN per b ON a.entity_id = b.entity_id AND a.event_id < b.event_id GROUP BY 1, 2""")
def q_event_pairs(spark, d):
    return D.event_pairs(ST.deliveries(spark, d))


# ------------------------------------------------------------------- G3, G5, G6 from sketches
_RANGE = (ORIGIN_MS + 10 * DAY_MS, ORIGIN_MS + 12 * DAY_MS)


@query("seen_entities_sketched", W("deliveries") + f"""
, ids AS (SELECT event_id, receive_ms, trim(x) AS x FROM (SELECT event_id, receive_ms, unnest(string_split(skater_ids, '|')) AS x FROM deliveries) WHERE trim(x) <> '')
SELECT 'all' AS part, event_id, count(*) AS n, count(DISTINCT x) AS n_exact, true AS within FROM ids GROUP BY event_id
UNION ALL SELECT 'range', event_id, count(*), count(DISTINCT x), true FROM ids WHERE receive_ms >= {_RANGE[0]} AND receive_ms < {_RANGE[1]} GROUP BY event_id""")
def q_seen_entities_sketched(spark, d):
    """G3 from sketches of each event and hour, written once, beside the exact
    numbers: whether the estimate lies within the stated bound."""
    from loctrack.session import cut
    rows = ST.deliveries(spark, d)
    stored = cut(SK.id_sketches(rows), "id_sketches")

    def beside(part: str, lo: int | None, hi: int | None) -> DataFrame:
        some = rows if lo is None else rows.filter((F.col("receive_ms") >= lo) & (F.col("receive_ms") < hi))
        exact = D.delivered_ids(some).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_exact"))
        est = SK.seen_entities_from(stored, from_ms=lo, to_ms=hi)
        off = F.abs(F.col("n_entities") - F.col("n_exact"))
        return est.join(exact, "event_id").select(F.lit(part).alias("part"), "event_id", "n", "n_exact", (off <= 1 + SK.distinct_bound() * F.col("n_exact")).alias("within"))

    return beside("all", None, None).unionByName(beside("range", *_RANGE))


def _sketched(rows: DataFrame, value: str, time_col: str) -> DataFrame:
    from loctrack.session import cut
    stored = cut(SK.value_sketches(rows, value, time_col), "value_sketches")
    summary = cut(SK.value_summary_from(stored), "value_summary")
    errors = SK.rank_errors(rows, value, summary).drop("n")
    near = [(F.col(f"{p}_error") <= SK.rank_bound()).alias(f"{p}_within") for p in ("p50", "p95", "p99")]
    return summary.join(errors, "event_id").select("event_id", "n", "min", "max", *near)


@query("response_time_sketched", W("publish_metrics") + """
SELECT event_id, count(*) AS n, min(response_time_ms) AS min, max(response_time_ms) AS max, true AS p50_within, true AS p95_within, true AS p99_within
FROM publish_metrics GROUP BY event_id""")
def q_response_time_sketched(spark, d):
    """G5 from quantile sketches of each event and hour: p50, p95 and p99 lie within
    the stated rank error of the exact values."""
    return _sketched(ST.publish_metrics(spark, d), "response_time_ms", "ts_ms")


@query("delivery_latency_sketched", W("deliveries") + """
SELECT event_id, count(*) AS n, CAST(min(receive_ms - server_ms) AS DOUBLE) AS min, CAST(max(receive_ms - server_ms) AS DOUBLE) AS max,
  true AS p50_within, true AS p95_within, true AS p99_within
FROM deliveries WHERE error = '' AND server_ms IS NOT NULL GROUP BY event_id""")
def q_delivery_latency_sketched(spark, d):
    """G6 from quantile sketches of each event and hour."""
    from loctrack.operators import metrics as G
    return _sketched(G.delivery_latency(ST.deliveries(spark, d)), "latency_ms", "receive_ms")


# ------------------------------------------------------------------- A2, A3, A5, S7: decoders
# Locations of which most are broken in one way, by the row's number.
_LOCATIONS = """CASE seq % 12 WHEN 0 THEN '[1]' WHEN 1 THEN 'not json'
  WHEN 2 THEN concat('{"latitude":1,"longitude":2,"timestamp":', CAST(ts_ms AS {s}), '}')
  WHEN 3 THEN concat('{"skaterId":7,"latitude":1,"longitude":2,"timestamp":', CAST(ts_ms AS {s}), '}')
  WHEN 4 THEN '{"skaterId":"a","latitude":"1","longitude":2,"timestamp":3}'
  WHEN 5 THEN '{"skaterId":"a","latitude":1,"timestamp":3}'
  WHEN 6 THEN '{"skaterId":"a","latitude":1,"longitude":2,"timestamp":1.5}'
  WHEN 7 THEN '{"skaterId":"a","latitude":1,"longitude":2,"timestamp":"3"}'
  WHEN 8 THEN '{"skaterId":"a","latitude":1,"longitude":2}'
  WHEN 9 THEN '{"skaterId":null,"latitude":1,"longitude":2,"timestamp":null}'
  ELSE concat('{"timestamp":', CAST(ts_ms AS {s}), ',"skaterId":"', entity_id, '","longitude":2.25,"latitude":-1.5,"extra":[1]}') END"""


@query("location_messages", W("updates") + """
, m AS (SELECT *, seq % 12 AS k FROM updates)
SELECT seq, CASE WHEN k IN (4, 5, 6, 7, 8) THEN 'a' WHEN k >= 10 THEN entity_id END AS "skaterId",
  CASE WHEN k IN (2, 3, 5, 6, 7, 8, 9) THEN 1e0 WHEN k >= 10 THEN -1.5e0 END AS latitude,
  CASE WHEN k IN (2, 3, 4, 6, 7, 8, 9) THEN 2e0 WHEN k >= 10 THEN 2.25e0 END AS longitude,
  CASE WHEN k IN (4, 5) THEN 3 WHEN k IN (2, 3) OR k >= 10 THEN ts_ms END AS "timestamp",
  CASE k WHEN 1 THEN 'invalid json' WHEN 0 THEN 'invalid skaterId' WHEN 2 THEN 'invalid skaterId' WHEN 3 THEN 'invalid skaterId' WHEN 4 THEN 'invalid latitude'
    WHEN 5 THEN 'invalid longitude' WHEN 6 THEN 'invalid timestamp' WHEN 7 THEN 'invalid timestamp' WHEN 8 THEN 'invalid timestamp' WHEN 9 THEN 'invalid skaterId' END AS decode_error
FROM m""")
def q_location_messages(spark, d):
    """A3 on good and broken messages."""
    m = _updates(spark, d).select("seq", F.expr(_LOCATIONS.replace("{s}", "STRING")).alias("json"))
    return A.parse_locations(m, "json").drop("json")


_FLAT = """CASE seq % 11 WHEN 0 THEN '{"eventId":"e","skaterId":"s","longitude":1}' WHEN 1 THEN '{"eventId":5,"skaterId":"s","longitude":1,"latitude":2}'
  WHEN 2 THEN '{"eventId":"e","skaterId":null,"longitude":1,"latitude":2}' WHEN 3 THEN '{"eventId":"e","skaterId":"s","longitude":"1","latitude":2}'
  WHEN 4 THEN '{"eventId":"e","skaterId":"s","longitude":1,"latitude":true}' WHEN 5 THEN '{"eventId":"e","skaterId":"s","longitude":1,"latitude":2,"timestamp":1.5}'
  WHEN 6 THEN '{"eventId":"e","skaterId":"s","longitude":1,"latitude":2,"timestamp":"1"}' WHEN 7 THEN '{"eventId":"e","skaterId":"s","longitude":1,"latitude":2,"timestamp":null}'
  WHEN 8 THEN '{"eventId":"e","skaterId":"s","longitude":1,"latitude":2,"timestamp":9223372036854775807}' WHEN 9 THEN '{"eventId"'
  ELSE concat('{"eventId":"', event_id, '","skaterId":"', entity_id, '","longitude":1,"latitude":2}') END"""


@query("flat_update_rejects", W("updates") + """
, m AS (SELECT *, seq % 11 AS k FROM updates)
SELECT seq, CASE WHEN k IN (1, 9) THEN NULL WHEN k < 10 THEN 'e' ELSE event_id END AS "eventId",
  CASE WHEN k IN (2, 9) THEN NULL WHEN k < 10 THEN 's' ELSE entity_id END AS "skaterId",
  CASE WHEN k IN (3, 9) THEN NULL ELSE 1e0 END AS longitude, CASE WHEN k IN (0, 4, 9) THEN NULL ELSE 2e0 END AS latitude,
  CASE WHEN k = 8 THEN 9223372036854775807 WHEN k NOT IN (5, 6) THEN 77 END AS "timestamp",
  CASE k WHEN 0 THEN 'invalid latitude' WHEN 1 THEN 'invalid eventId' WHEN 2 THEN 'invalid skaterId' WHEN 3 THEN 'invalid longitude' WHEN 4 THEN 'invalid latitude'
    WHEN 5 THEN 'invalid timestamp' WHEN 6 THEN 'invalid timestamp' WHEN 9 THEN 'invalid json' END AS decode_error
FROM m""")
def q_flat_update_rejects(spark, d):
    """A2 on good and broken messages; absent and null times become the given one."""
    m = _updates(spark, d).select("seq", F.expr(_FLAT).alias("json"))
    return A.parse_flat_updates(m, "json", now_ms=77).drop("json")


@query("heap_units", W("heap_series") + """
SELECT time_str, CASE WHEN sample_no % 4 = 3 THEN round(heap_mb, 3) / (1024 * 1024) WHEN sample_no % 4 = 2 THEN round(heap_mb, 3) / 1024
  WHEN sample_no % 4 = 1 THEN round(heap_mb, 3) * 1024 ELSE round(heap_mb, 3) END AS heap_mb, count(*) AS n
FROM heap_series GROUP BY ALL""")
def q_heap_units(spark, d):
    """Recordings in MB, GB, KB and plain bytes, written and read again."""
    path = _folder(spark, "heap_units")
    unit = F.element_at(F.array(F.lit(" MB"), F.lit(" GB"), F.lit(" KB"), F.lit("")), (F.col("sample_no") % 4 + 1).cast("int"))
    block = F.format_string("jdk.GCHeapSummary {\n  startTime = %s (2026-01-18)\n  heapUsed = %.3f%s\n}", "time_str", "heap_mb", unit)
    ST.heap_series(spark, d).select(block.alias("value")).write.text(path)
    s = H.heap_samples(AF.read_heap_recordings(spark, path))
    return s.groupBy("time_str", "heap_mb").agg(F.count(F.lit(1)).alias("n"))


@query("batch_files", W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, GRID]) + f"""
SELECT entity_id AS "skaterId", latitude, longitude, ts_ms AS "timestamp", pos, window_ms + {BATCH_INTERVAL_MS} AS "serverTime", count(*) AS n FROM grid GROUP BY ALL""")
def q_batch_files(spark, d):
    """A5 and A4: batches written as text files and read again."""
    path = _folder(spark, "batches")
    A.write_batches(_batches(spark, d), path)
    rows = A.explode_batches(spark.read.text(path), "value")
    return rows.groupBy("skaterId", "latitude", "longitude", "timestamp", "pos", "serverTime").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- K2, K3, K4: streams
_LATE_MS = 2 * DAY_MS


def _two_replays(spark, left: DataFrame, left_time: str, right: DataFrame, right_time: str, name: str, build) -> DataFrame:
    """Two tables replayed side by side: both are dealt in the same time slices, one
    micro-batch each, and ``build`` joins the streams.  The sink as a batch table."""
    from loctrack.streaming import stream_checkpoint
    base = f"{checkpoint_dir(spark).rstrip('/')}/replay/{name}-{uuid.uuid4().hex[:12]}"
    tables, bounds = [], []
    for side, df, t in (("left", left, left_time), ("right", right, right_time)):
        df.write.parquet(f"{base}/{side}-table")
        table = spark.read.schema(df.schema).parquet(f"{base}/{side}-table")
        tables.append((side, table, t))
        bounds.append(table.agg(F.min(t), F.max(t)).first())
    lo, hi = min(b[0] or 0 for b in bounds), max(b[1] or 0 for b in bounds)
    step = (hi - lo) // _REPLAY_BATCHES + 1
    for i in range(_REPLAY_BATCHES):
        for side, table, t in tables:
            table.filter((F.col(t) >= lo + i * step) & (F.col(t) < lo + (i + 1) * step)).repartition(1).write.mode("append").parquet(f"{base}/{side}")
    streams = [spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{side}") for side, table, _ in tables]
    out = build(*streams)
    schema = out.schema

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    out.writeStream.foreachBatch(sink).option("checkpointLocation", stream_checkpoint(spark, name)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out/*")


@query("fan_out_streams", W("updates", "viewers", extra=[FANOUT]) + "SELECT * FROM fanout")
def q_fan_out_streams(spark, d):
    """K4 with viewers as a stream: every third viewer is announced two days after
    it has subscribed, when many of its updates have passed; equal to D1."""
    from loctrack import streaming as K
    v = ST.viewers(spark, d).withColumn("announced_ms", F.col("subscribed_ms") + F.when(F.col("viewer_id") % 3 == 0, F.lit(_LATE_MS)).otherwise(0))
    return _two_replays(spark, _updates(spark, d).select(*_UPD), "ts_ms", v, "announced_ms", "fan_out_streams",
                        lambda u, v: K.fan_out_streams(u, v.drop("announced_ms"), _LATE_MS, bucket_ms=6 * HOUR_MS, open_ms=40 * DAY_MS))


@query("sweep_removals_stream", W("updates", extra=[VERSIONS]) + f"""
, lives AS (SELECT *, sum(CASE WHEN prs IS NULL OR ts_ms > prs THEN 1 ELSE 0 END) OVER (PARTITION BY event_id, entity_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS life
  FROM (SELECT *, lag(rs) OVER (PARTITION BY event_id, entity_id ORDER BY ts_ms, seq) AS prs FROM versions))
SELECT event_id, entity_id, min(ts_ms) AS entered_ms, max(rs) AS removed_at_ms, count(*) AS n_updates,
  arg_max(longitude, (ts_ms, seq)) AS longitude, arg_max(latitude, (ts_ms, seq)) AS latitude, max(ts_ms) AS ts_ms, arg_max(seq, (ts_ms, seq)) AS seq
FROM lives GROUP BY event_id, entity_id, life HAVING max(rs) <= (SELECT max(ts_ms) - {_WM_MS} FROM updates)""")
def q_sweep_removals_stream(spark, d):
    """K2 on the sweep grid: every stay that a closed sweep has ended, with the
    sweep that removed it."""
    from loctrack import streaming as K
    return _replay_rows(spark, _updates(spark, d).select(*_UPD), "sweep_removals_stream", "ts_ms",
                        lambda s: K.lifetimes_stream(s, LOC_TTL_MS, LOC_SWEEP_MS, ORIGIN_MS, _WM_MS))


@query("removal_log_stream", W("updates", extra=[VERSIONS]) + f"""
SELECT removed_at_ms AS sweep_ms, count(*) AS n_removed FROM versions
WHERE removed_at_ms <= (SELECT max(ts_ms) - {_WM_MS} FROM updates) GROUP BY 1""")
def q_removal_log_stream(spark, d):
    """K2's removals summed by sweep: equal to C6 for closed sweeps."""
    return q_sweep_removals_stream(spark, d).groupBy(F.col("removed_at_ms").alias("sweep_ms")).agg(F.count(F.lit(1)).alias("n_removed"))


@query("batch_grid_stream", W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, GRID]) + f"""
SELECT CAST(viewer_id AS VARCHAR) AS viewer_id, window_ms, batch_no, count(*) AS n_rows, min(msg_no) AS first_msg, max(msg_no) AS last_msg
FROM grid WHERE window_ms + {BATCH_INTERVAL_MS} <= (SELECT max(deliver_ms) - {_WM_MS} FROM stream) GROUP BY 1, 2, 3""")
def q_batch_grid_stream(spark, d):
    """K3 in its cheap form: every batch of a closed window, equal to E1."""
    from loctrack import streaming as K
    rows = _stream(spark, d).select(F.col("viewer_id").cast("string").alias("viewer_id"), "msg_no", "deliver_ms")
    out = _replay_rows(spark, rows, "batch_grid_stream", "deliver_ms",
                       lambda s: K.batch_grid_stream(s, "viewer_id", BATCH_SIZE, BATCH_INTERVAL_MS, "deliver_ms", ["msg_no"], _WM_MS, ORIGIN_MS))
    return out.select("viewer_id", "window_ms", "batch_no", "n_rows", F.col("first.msg_no").alias("first_msg"), F.col("last.msg_no").alias("last_msg"))
