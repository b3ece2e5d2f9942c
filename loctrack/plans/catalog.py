"""Registered queries: one per operator of the survey, each with its DuckDB
oracle where the result is SQL-expressible.

Every query reads the driver tables (through the stand-ins) in full; nothing is
sampled, capped or filtered by id to keep it cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loctrack.plans import standins as ST
from loctrack.session import cut
from loctrack.plans.standins import DAY_MS, HOUR_MS, ORIGIN_MS, SNAPSHOT_AT_MS, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Fixed parameters scaled to the stand-in data (see FIXTURES.md).
LOC_TTL_MS = 24 * HOUR_MS
LOC_SWEEP_MS = 6 * HOUR_MS
CHAN_TTL_MS = 3_600_000
CHAN_SWEEP_MS = 600_000
BATCH_SIZE = 3
BATCH_INTERVAL_MS = 6 * HOUR_MS
NEWEST_N = 128


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _r(x: str, d: int = 3) -> str:
    return f"round({x}, {d})"


# =========================================================================== B: validation
from loctrack.operators import validate as V  # noqa: E402


@query("validate_updates", with_views("updates_raw", "validated") + """
SELECT seq, event_id, entity_id, error_code FROM validated""")
def q_validate_updates(spark, d):
    return V.validate_updates(ST.updates_raw(spark, d)).select("seq", "event_id", "entity_id", "error_code")


@query("rejection_summary", with_views("updates_raw", "validated") + """
SELECT error_code, count(*) AS n FROM validated WHERE error_code IS NOT NULL GROUP BY error_code""")
def q_rejection_summary(spark, d):
    return V.rejection_summary(V.validate_updates(ST.updates_raw(spark, d)))


# =========================================================================== C: keyed state
from loctrack.operators import state as C  # noqa: E402

_LAST_SWEEP = C.last_sweep_ms(SNAPSHOT_AT_MS, ORIGIN_MS, LOC_SWEEP_MS)
_LATEST_SQL = """
SELECT event_id, entity_id, longitude, latitude, ts_ms, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, entity_id ORDER BY ts_ms DESC, seq DESC) AS rn
  FROM {src}) WHERE rn = 1"""


@query("snapshot_as_of", with_views("updates") + f"""
SELECT * FROM ({_LATEST_SQL.format(src=f"(SELECT * FROM updates WHERE ts_ms <= {SNAPSHOT_AT_MS})")})
WHERE ts_ms > {_LAST_SWEEP - LOC_TTL_MS}""")
def q_snapshot_as_of(spark, d):
    return C.snapshot_as_of(ST.updates(spark, d, SNAPSHOT_AT_MS), SNAPSHOT_AT_MS, LOC_TTL_MS, LOC_SWEEP_MS, ORIGIN_MS)



def W(*standins: str, extra: list[tuple[str, str]] = ()) -> str:
    """WITH clause: stand-in views plus extra named views."""
    head = with_views(*standins).rstrip()
    for name, body in extra:
        head += f",\n{name} AS (\n{body}\n)"
    return head + "\n"


def _uuid_of(text: str) -> str:
    import hashlib
    h = hashlib.md5(text.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


from loctrack.plans import sqltext as Q  # noqa: E402

END_MS = ORIGIN_MS + 30 * DAY_MS        # 2024-01-31 00:00 UTC
MID_MS = ORIGIN_MS + 15 * DAY_MS        # 2024-01-16 00:00 UTC
_TTL_S = (LOC_TTL_MS // 1000) * 1000

# ---- shared SQL fragments --------------------------------------------------------------
_RS = f"{ORIGIN_MS} + greatest({Q.ceil_div(f'ts_ms + {_TTL_S} - {ORIGIN_MS}', LOC_SWEEP_MS)}, 1) * {LOC_SWEEP_MS}"
VERSIONS = ("versions", f"""
SELECT *, CASE WHEN next_ts_ms IS NULL OR next_ts_ms > rs THEN rs END AS removed_at_ms,
  coalesce(CASE WHEN next_ts_ms IS NULL OR next_ts_ms > rs THEN rs END, next_ts_ms) AS end_ms
FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY event_id, entity_id ORDER BY ts_ms, seq) AS next_ts_ms,
        {_RS} AS rs FROM updates)""")
_ISL_ORDER = "ORDER BY ts_ms, entity_id, seq"
PRESENCE = ("presence", f"""
SELECT event_id, island_no, min(ts_ms) AS present_from_ms, max(end_ms) AS removed_at_ms,
  count(*) AS n_updates, count(DISTINCT entity_id) AS n_entities
FROM (SELECT *, CAST(sum(CASE WHEN prev_end IS NULL OR ts_ms > prev_end THEN 1 ELSE 0 END)
                 OVER (PARTITION BY event_id {_ISL_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island_no
      FROM (SELECT *, max(end_ms) OVER (PARTITION BY event_id {_ISL_ORDER}
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM versions))
GROUP BY event_id, island_no""")
_K = Q.floor_div(f"v.subscribed_ms - {ORIGIN_MS}", LOC_SWEEP_MS)
SNAPVIEW = ("snapview", f"""
SELECT v.viewer_id, u.event_id, u.entity_id, u.longitude, u.latitude, u.ts_ms, u.seq, v.subscribed_ms
FROM versions u JOIN viewers v ON u.event_id = v.event_id AND u.ts_ms <= v.subscribed_ms
  AND (u.next_ts_ms IS NULL OR u.next_ts_ms > v.subscribed_ms)
WHERE {_K} < 1 OR u.ts_ms > {ORIGIN_MS} + {_K} * {LOC_SWEEP_MS} - {_TTL_S}""")
FANOUT = ("fanout", """
SELECT v.viewer_id, u.event_id, u.entity_id, u.longitude, u.latitude, u.ts_ms, u.seq, v.subscribed_ms
FROM updates u JOIN viewers v ON u.event_id = v.event_id AND u.ts_ms > v.subscribed_ms
  AND (v.left_ms IS NULL OR u.ts_ms <= v.left_ms)""")
STREAM = ("stream", """
SELECT *, CAST(row_number() OVER (PARTITION BY viewer_id ORDER BY deliver_ms, phase, ts_ms, seq, entity_id) AS BIGINT) AS msg_no
FROM (SELECT *, 0 AS phase, subscribed_ms AS deliver_ms FROM snapview
      UNION ALL SELECT *, 1 AS phase, ts_ms AS deliver_ms FROM fanout)""")
_STREAM_VIEWS = ["updates", "viewers"]
_STREAM_EXTRA = [VERSIONS, SNAPVIEW, FANOUT, STREAM]
GRID = ("grid", f"""
SELECT *, {Q.grid_floor('deliver_ms', ORIGIN_MS, BATCH_INTERVAL_MS)} AS window_ms,
  ((row_number() OVER (PARTITION BY viewer_id, {Q.grid_floor('deliver_ms', ORIGIN_MS, BATCH_INTERVAL_MS)}
     ORDER BY deliver_ms, phase, ts_ms, seq, entity_id)) - 1) // {BATCH_SIZE} AS batch_no,
  (row_number() OVER (PARTITION BY viewer_id, {Q.grid_floor('deliver_ms', ORIGIN_MS, BATCH_INTERVAL_MS)}
     ORDER BY deliver_ms, phase, ts_ms, seq, entity_id) - 1) % {BATCH_SIZE} AS pos
FROM stream""")


def _updates(spark, d):
    return ST.updates(spark, d)


def _updates_once(spark, d):
    """The updates as a written table, for operators that read them in several
    branches: bodies and ids are decoded once."""
    return cut(_updates(spark, d), "updates")


def _stream(spark, d, viewers=None, number=True):
    from loctrack.operators import joins as D
    return D.viewer_stream(_updates_once(spark, d), viewers if viewers is not None else ST.viewers(spark, d),
                           LOC_TTL_MS, LOC_SWEEP_MS, ORIGIN_MS, number=number)


# =========================================================================== A/B: raw requests
_RAW_SQL = """
SELECT seq, CASE WHEN n_coords IS NULL OR isnan(lon) THEN NULL ELSE n_coords END AS n_coords,
  CASE WHEN n_coords IS NULL OR isnan(lon) THEN NULL ELSE lon END AS longitude,
  CASE WHEN n_coords IS NULL OR isnan(lon) OR n_coords < 2 THEN NULL ELSE lat END AS latitude
FROM updates_raw"""


@query("body_coordinates", W("updates_raw") + _RAW_SQL)
def q_body_coordinates(spark, d):
    raw = ST.raw_requests(spark, d)
    c = V.coordinates_from_body("body")
    return raw.select("seq", F.when(c.isNotNull(), F.size(c)).alias("n_coords"),
                      F.get(c, 0).alias("longitude"), F.get(c, 1).alias("latitude"))


_VALIDATE_RAW_SQL = f"""
SELECT seq, event_key AS event_id, entity_key AS entity_id,
  CASE WHEN NOT {Q.is_valid_uuid('event_key')} THEN 'INVALID_SKATING_EVENT_ID'
       WHEN NOT {Q.is_valid_uuid('entity_key')} THEN 'INVALID_SKATER_ID'
       WHEN n_coords IS NULL OR isnan(lon) THEN 'MISSING_COORDINATES'
       WHEN n_coords <> 2 THEN 'INVALID_COORDINATES_LENGTH'
       WHEN NOT {Q.in_range('lon', -180.0, 180.0)} THEN 'INVALID_LONGITUDE'
       WHEN NOT {Q.in_range('lat', -90.0, 90.0)} THEN 'INVALID_LATITUDE' END AS error_code
FROM updates_raw"""


@query("validate_raw", W("updates_raw") + _VALIDATE_RAW_SQL)
def q_validate_raw(spark, d):
    return V.validate_updates(ST.raw_requests(spark, d)).select("seq", "event_id", "entity_id", "error_code")


@query("accepted_updates", W("updates") + "SELECT * FROM updates")
def q_accepted_updates(spark, d):
    return _updates(spark, d)


@query("rejected_payloads", W("updates_raw", "validated") + """
SELECT seq, error_code AS error,
  CASE error_code
    WHEN 'INVALID_SKATING_EVENT_ID' THEN 'Skating event ID must be a valid UUID'
    WHEN 'INVALID_SKATER_ID' THEN 'Skater ID must be a valid UUID'
    WHEN 'MISSING_COORDINATES' THEN 'Request must contain ''coordinates'' field with array of numbers'
    WHEN 'INVALID_COORDINATES_LENGTH' THEN 'Coordinates array must contain exactly 2 numbers [longitude, latitude]'
    WHEN 'INVALID_LONGITUDE' THEN 'Longitude must be between -180.0 and 180.0'
    WHEN 'INVALID_LATITUDE' THEN 'Latitude must be between -90.0 and 90.0' END AS message,
  CASE error_code WHEN 'INVALID_LONGITUDE' THEN 'coordinates[0]' WHEN 'INVALID_LATITUDE' THEN 'coordinates[1]' END AS detail_field,
  CASE error_code WHEN 'INVALID_LONGITUDE' THEN lon WHEN 'INVALID_LATITUDE' THEN lat END AS detail_value,
  CASE error_code WHEN 'INVALID_LONGITUDE' THEN 'range(-180.0, 180.0)' WHEN 'INVALID_LATITUDE' THEN 'range(-90.0, 90.0)' END AS detail_constraint,
  400 AS status
FROM validated WHERE error_code IS NOT NULL""")
def q_rejected_payloads(spark, d):
    _, rej = V.split_valid(V.validate_updates(ST.updates_raw(spark, d)))
    p = V.error_payload(rej)
    return p.select("seq", "error", "message", F.col("details.field").alias("detail_field"),
                    F.col("details.value").alias("detail_value"),
                    F.col("details.constraint").alias("detail_constraint"), "status")


_TWO_EVENTS = f" {_uuid_of('click')} , {_uuid_of('view')},, "


@query("events_filter", W("updates") + f"""
SELECT * FROM updates WHERE event_id IN ('{_uuid_of('click')}', '{_uuid_of('view')}')""")
def q_events_filter(spark, d):
    return V.for_events(_updates(spark, d), _TWO_EVENTS)


# =========================================================================== C: keyed state
@query("latest_locations", W("updates") + _LATEST_SQL.format(src="updates"))
def q_latest_locations(spark, d):
    return C.latest_locations(_updates(spark, d))


@query("upsert", W("updates") + _LATEST_SQL.format(
    src=f"(SELECT * FROM ({_LATEST_SQL.format(src=f'(SELECT * FROM updates WHERE ts_ms < {MID_MS})')}) "
        f"UNION ALL SELECT * FROM updates WHERE ts_ms >= {MID_MS})"))
def q_upsert(spark, d):
    u = _updates(spark, d)
    snap = C.latest_locations(u.filter(F.col("ts_ms") < MID_MS))
    return C.upsert(snap, u.filter(F.col("ts_ms") >= MID_MS))


@query("retain_live", W("updates") + f"""
SELECT * FROM ({_LATEST_SQL.format(src="updates")}) WHERE ts_ms > {END_MS - _TTL_S}""")
def q_retain_live(spark, d):
    return C.retain_live(C.latest_locations(_updates(spark, d)), END_MS, LOC_TTL_MS)


@query("sweep_summary", W("updates") + f"""
SELECT event_id, count(*) AS n_before, count_if(ts_ms <= {SNAPSHOT_AT_MS - _TTL_S}) AS n_removed,
  count_if(ts_ms > {SNAPSHOT_AT_MS - _TTL_S}) AS n_kept, count_if(ts_ms > {SNAPSHOT_AT_MS - _TTL_S}) = 0 AS emptied
FROM ({_LATEST_SQL.format(src=f"(SELECT * FROM updates WHERE ts_ms <= {SNAPSHOT_AT_MS})")}) GROUP BY event_id""")
def q_sweep_summary(spark, d):
    snap = C.latest_locations(_updates(spark, d).filter(F.col("ts_ms") <= SNAPSHOT_AT_MS))
    return C.sweep(snap, SNAPSHOT_AT_MS, LOC_TTL_MS)[1]


@query("removal_log", W("updates", extra=[VERSIONS]) + """
SELECT removed_at_ms AS sweep_ms, count(*) AS n_removed FROM versions
WHERE removed_at_ms IS NOT NULL GROUP BY removed_at_ms""")
def q_removal_log(spark, d):
    return C.removal_log(_updates_once(spark, d), LOC_TTL_MS, LOC_SWEEP_MS, ORIGIN_MS)


@query("event_presence", W("updates", extra=[VERSIONS, PRESENCE]) + "SELECT * FROM presence")
def q_event_presence(spark, d):
    return C.event_presence(_updates_once(spark, d), LOC_TTL_MS, LOC_SWEEP_MS, ORIGIN_MS)


# A short ttl, so that an event is empty between its updates.
_GAP_TTL_MS, _GAP_SWEEP_MS = 600_000, 60_000
_RS_GAP = f"{ORIGIN_MS} + greatest({Q.ceil_div(f'ts_ms + {_GAP_TTL_MS} - {ORIGIN_MS}', _GAP_SWEEP_MS)}, 1) * {_GAP_SWEEP_MS}"


@query("event_presence_gaps", W("updates", extra=[("versions", VERSIONS[1].replace(_RS, _RS_GAP)), PRESENCE]) + "SELECT * FROM presence")
def q_event_presence_gaps(spark, d):
    return C.event_presence(_updates_once(spark, d), _GAP_TTL_MS, _GAP_SWEEP_MS, ORIGIN_MS)


def _sessions_sql(removal) -> str:
    return f"""
SELECT event_id, session_no, min(access_ms) AS started_ms, max(access_ms) AS last_access_ms,
  count(*) AS n_accesses, {removal('max(access_ms)')} AS removed_at_ms
FROM (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR access_ms > {removal('prev')} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY event_id ORDER BY access_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
      FROM (SELECT *, lag(access_ms) OVER (PARTITION BY event_id ORDER BY access_ms) AS prev FROM accesses))
GROUP BY event_id, session_no"""


def _grid_removal(x: str) -> str:
    return f"({ORIGIN_MS} + ({Q.floor_div(f'{x} + {CHAN_TTL_MS} - {ORIGIN_MS}', CHAN_SWEEP_MS)} + 1) * {CHAN_SWEEP_MS})"


@query("channel_sessions", W("accesses") + _sessions_sql(_grid_removal))
def q_channel_sessions(spark, d):
    return C.channel_sessions(ST.accesses(spark, d), CHAN_TTL_MS, CHAN_SWEEP_MS, ORIGIN_MS)


@query("channel_sessions_gap", W("accesses") + _sessions_sql(lambda x: f"({x} + {CHAN_TTL_MS})"))
def q_channel_sessions_gap(spark, d):
    return C.channel_sessions(ST.accesses(spark, d), CHAN_TTL_MS, None)


IDLE_AT_MS = END_MS + HOUR_MS           # all channels have been left by then


@query("idle_channels", W("accesses") + f"""
SELECT event_id, last_access_ms, {IDLE_AT_MS} - last_access_ms AS idle_ms FROM (
  SELECT event_id, max(access_ms) AS last_access_ms FROM accesses WHERE access_ms <= {IDLE_AT_MS} GROUP BY event_id)
WHERE last_access_ms < {IDLE_AT_MS - CHAN_TTL_MS}""")
def q_idle_channels(spark, d):
    return C.idle_channels(ST.accesses(spark, d), IDLE_AT_MS, CHAN_TTL_MS)


@query("idle_channels_now", W("accesses") + f"""
SELECT event_id, last_access_ms, {SNAPSHOT_AT_MS} - last_access_ms AS idle_ms FROM (
  SELECT event_id, max(access_ms) AS last_access_ms FROM accesses WHERE access_ms <= {SNAPSHOT_AT_MS} GROUP BY event_id)
WHERE last_access_ms < {SNAPSHOT_AT_MS - 60_000}""")
def q_idle_channels_now(spark, d):
    return C.idle_channels(ST.accesses(spark, d), SNAPSHOT_AT_MS, 60_000)


# =========================================================================== D: joins
from loctrack.operators import joins as D  # noqa: E402


@query("fan_out", W("updates", "viewers", extra=[FANOUT]) + "SELECT * FROM fanout")
def q_fan_out(spark, d):
    return D.fan_out(_updates_once(spark, d), ST.viewers(spark, d))


@query("snapshot_for_viewers", W("updates", "viewers", extra=[VERSIONS, SNAPVIEW]) + "SELECT * FROM snapview")
def q_snapshot_for_viewers(spark, d):
    return D.snapshot_for_viewers(_updates_once(spark, d), ST.viewers(spark, d), LOC_TTL_MS, LOC_SWEEP_MS, ORIGIN_MS)


@query("viewer_stream", W(*_STREAM_VIEWS, extra=_STREAM_EXTRA) + "SELECT * FROM stream")
def q_viewer_stream(spark, d):
    return _stream(spark, d)


_OPEN_AT = f"subscribed_ms <= {SNAPSHOT_AT_MS} AND (left_ms IS NULL OR left_ms > {SNAPSHOT_AT_MS})"


@query("stale_in_view", W("updates", extra=[
    ("viewers", f"SELECT * FROM ({ST.SQL['viewers']}) WHERE {_OPEN_AT}"), *_STREAM_EXTRA]) + f"""
SELECT viewer_id, event_id, entity_id, longitude, latitude, ts_ms, seq, {SNAPSHOT_AT_MS} - ts_ms AS age_ms
FROM (SELECT *, row_number() OVER (PARTITION BY viewer_id, event_id, entity_id ORDER BY ts_ms DESC, seq DESC) AS rn
      FROM stream WHERE deliver_ms <= {SNAPSHOT_AT_MS}) v
WHERE rn = 1 AND NOT EXISTS (
  SELECT 1 FROM ({_LATEST_SQL.format(src=f"(SELECT * FROM updates WHERE ts_ms <= {SNAPSHOT_AT_MS})")}) l
  WHERE l.event_id = v.event_id AND l.entity_id = v.entity_id AND l.ts_ms > {_LAST_SWEEP - _TTL_S})""")
def q_stale_in_view(spark, d):
    vw = ST.viewers(spark, d).filter(F.expr(_OPEN_AT))
    view = D.viewer_view_at(_stream(spark, d, vw, number=False), SNAPSHOT_AT_MS)
    live = C.snapshot_as_of(ST.updates(spark, d, SNAPSHOT_AT_MS), SNAPSHOT_AT_MS, LOC_TTL_MS, LOC_SWEEP_MS, ORIGIN_MS)
    return D.stale_in_view(view, live, SNAPSHOT_AT_MS)


_IDS_SQL = """
SELECT DISTINCT event_id, trim(x) AS entity_id FROM (SELECT event_id, unnest(string_split(skater_ids, '|')) AS x FROM deliveries)
WHERE trim(x) <> ''"""


@query("isolation_check", W("deliveries") + f"""
SELECT entity_id, count(*) AS n_events FROM ({_IDS_SQL}) GROUP BY entity_id HAVING count(*) > 1""")
def q_isolation_check(spark, d):
    return D.isolation_check(ST.deliveries(spark, d))


# =========================================================================== E: windows
from loctrack.operators import windows as E  # noqa: E402

_GRID_ORDER = ["phase", "ts_ms", "seq", "entity_id"]


def _grid(spark, d):
    # msg_no is the viewer's consecutive position in (deliver_ms, *_GRID_ORDER)
    return E.batch_grid(cut(_stream(spark, d), "stream"), "viewer_id", "deliver_ms", BATCH_SIZE, BATCH_INTERVAL_MS,
                        ORIGIN_MS, _GRID_ORDER, position="msg_no")


@query("batch_grid_windows", W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, GRID]) + """
SELECT viewer_id, ts_ms, seq, entity_id, window_ms, batch_no FROM grid""")
def q_batch_grid_windows(spark, d):
    """The same grid without the shortcut of known positions."""
    return E.batch_grid(cut(_stream(spark, d, number=False), "stream"), "viewer_id", "deliver_ms", BATCH_SIZE, BATCH_INTERVAL_MS,
                        ORIGIN_MS, _GRID_ORDER).select("viewer_id", "ts_ms", "seq", "entity_id", "window_ms", "batch_no")


@query("batch_grid", W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, GRID]) + """
SELECT viewer_id, msg_no, window_ms, batch_no FROM grid""")
def q_batch_grid(spark, d):
    return _grid(spark, d).select("viewer_id", "msg_no", "window_ms", "batch_no")


def _batches(spark, d):
    return E.to_batches(_grid(spark, d), ["viewer_id", "event_id"], BATCH_INTERVAL_MS,
                        ["deliver_ms", *_GRID_ORDER])


@query("to_batches", W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, GRID]) + f"""
SELECT viewer_id, event_id, window_ms, batch_no, window_ms + {BATCH_INTERVAL_MS} AS serverTime,
  count(*) AS n_locations, string_agg(entity_id || '/' || printf('%.6f', latitude) || '/' || printf('%.6f', longitude)
    || '/' || ts_ms, ' ' ORDER BY pos) AS locations_text
FROM grid GROUP BY viewer_id, event_id, window_ms, batch_no""")
def q_to_batches(spark, d):
    b = _batches(spark, d)
    return b.select("viewer_id", "event_id", "window_ms", "batch_no", "serverTime",
                    F.size("locations").alias("n_locations"),
                    F.array_join(F.transform("locations", lambda x: F.concat_ws(
                        "/", x["skaterId"], F.format_string("%.6f", x["latitude"]), F.format_string("%.6f", x["longitude"]),
                        x["timestamp"])), " ").alias("locations_text"))


# Where the group that opens at a row is followed by the next one; then the
# opening rows, one after the other.
NEXT_OPEN = ("next_open", f"""
SELECT viewer_id, msg_no AS i, deliver_ms AS open_ms, least(msg_no + {BATCH_SIZE}, 1 + count(*) OVER (
  PARTITION BY viewer_id ORDER BY deliver_ms RANGE BETWEEN UNBOUNDED PRECEDING AND {BATCH_INTERVAL_MS - 1} FOLLOWING)) AS nxt
FROM stream""")
OPENS = ("opens", """
SELECT viewer_id, i, open_ms, nxt, CAST(0 AS BIGINT) AS group_no FROM next_open WHERE i = 1
UNION ALL
SELECT n.viewer_id, n.i, n.open_ms, n.nxt, o.group_no + 1 FROM opens o JOIN next_open n ON n.viewer_id = o.viewer_id AND n.i = o.nxt""")


@query("group_within", "WITH RECURSIVE " + W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, NEXT_OPEN, OPENS]).removeprefix("WITH ") + """
SELECT s.viewer_id, s.msg_no, s.deliver_ms, o.group_no, o.open_ms AS group_open_ms
FROM stream s JOIN opens o ON s.viewer_id = o.viewer_id AND s.msg_no >= o.i AND s.msg_no < o.nxt""")
def q_group_within(spark, d):
    s = cut(_stream(spark, d).select("viewer_id", "msg_no", "deliver_ms"), "stream")
    return E.group_within(s, "viewer_id", BATCH_SIZE, BATCH_INTERVAL_MS, ts="deliver_ms", order=["msg_no"],
                          position="msg_no")


@query("newest_n", W("updates") + f"""
SELECT event_id, entity_id, longitude, latitude, ts_ms, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts_ms DESC, seq DESC) AS rn FROM updates)
WHERE rn <= {NEWEST_N}""")
def q_newest_n(spark, d):
    return E.newest_n(_updates(spark, d), NEWEST_N)


@query("newest_n_dropped", W("updates") + f"""
SELECT event_id, count(*) AS n_rows, greatest(count(*) - {NEWEST_N}, 0) AS n_dropped FROM updates GROUP BY event_id""")
def q_newest_n_dropped(spark, d):
    return E.dropped_count(_updates(spark, d), NEWEST_N)


@query("viewer_table", W(*_STREAM_VIEWS, extra=_STREAM_EXTRA) + """
SELECT viewer_id, entity_id, printf('%.6f', latitude) AS latitude_text, printf('%.6f', longitude) AS longitude_text,
  strftime(make_timestamp(ts_ms * 1000), '%I:%M:%S %p') AS time_text, ts_ms
FROM (SELECT *, row_number() OVER (PARTITION BY viewer_id, entity_id ORDER BY ts_ms DESC, seq DESC) AS rn FROM stream)
WHERE rn = 1""")
def q_viewer_table(spark, d):
    return E.viewer_table(_stream(spark, d, number=False))


@query("viewer_stats", W(*_STREAM_VIEWS, extra=_STREAM_EXTRA) + """
SELECT viewer_id, count(DISTINCT entity_id) AS n_entities, max(ts_ms) AS last_update_ms, count(*) AS n_rows
FROM stream GROUP BY viewer_id""")
def q_viewer_stats(spark, d):
    return E.viewer_stats(_stream(spark, d, number=False))


@query("number_messages", W("deliveries") + """
SELECT event_id, viewer_number, seq, receive_ms, error,
  CAST(sum(CASE WHEN error = '' THEN 1 ELSE 0 END) OVER (PARTITION BY event_id, viewer_number
       ORDER BY receive_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS message_count
FROM deliveries""")
def q_number_messages(spark, d):
    return E.number_messages(ST.deliveries(spark, d)).select(
        "event_id", "viewer_number", "seq", "receive_ms", "error", "message_count")


_IDLE_MS = 24 * HOUR_MS


@query("resume_check", W("deliveries") + f"""
SELECT event_id, viewer_number, prev AS silent_from_ms, receive_ms AS resumed_ms, receive_ms - prev AS silence_ms
FROM (SELECT *, lag(receive_ms) OVER (PARTITION BY event_id, viewer_number ORDER BY receive_ms, seq) AS prev
      FROM deliveries WHERE error = '')
WHERE receive_ms - prev > {_IDLE_MS}""")
def q_resume_check(spark, d):
    return E.resume_check(ST.deliveries(spark, d), _IDLE_MS)


# =========================================================================== G: metrics
from loctrack.operators import metrics as G  # noqa: E402


@query("record_counts", W("publish_metrics") + """
SELECT event_id, count(*) AS n_records FROM publish_metrics GROUP BY event_id""")
def q_record_counts(spark, d):
    return G.record_counts(ST.publish_metrics(spark, d))


@query("error_summary", W("publish_metrics") + """
SELECT event_id, count(*) AS n_records, count_if(error <> '') AS n_errors,
  count_if(error <> '') / count(*) AS error_rate
FROM publish_metrics GROUP BY event_id""")
def q_error_summary(spark, d):
    return G.error_summary(ST.publish_metrics(spark, d))


_CLASS_SQL = "CASE " + " ".join(
    f"WHEN starts_with(error, '{p}') THEN '{p}'" for p in sorted(G.S.ERROR_PREFIXES, key=len, reverse=True)
) + " ELSE 'other' END"


@query("error_classes", W("publish_metrics", "deliveries") + f"""
SELECT 'publish' AS source, {_CLASS_SQL} AS error_class, count(*) AS n_errors FROM publish_metrics
WHERE error <> '' GROUP BY 2
UNION ALL
SELECT 'delivery' AS source, {_CLASS_SQL} AS error_class, count(*) AS n_errors FROM deliveries
WHERE error <> '' GROUP BY 2""")
def q_error_classes(spark, d):
    a = G.error_classes(ST.publish_metrics(spark, d)).select(F.lit("publish").alias("source"), "*")
    b = G.error_classes(ST.deliveries(spark, d)).select(F.lit("delivery").alias("source"), "*")
    return a.unionByName(b)


@query("seen_entities", W("deliveries") + f"""
SELECT event_id, count(*) AS n_entities FROM ({_IDS_SQL}) GROUP BY event_id""")
def q_seen_entities(spark, d):
    return G.seen_entities(ST.deliveries(spark, d))


_EXP_INTERVAL_S, _EXP_MINUTES = 60, 68


@query("expected_count_check", W("publish_metrics") + f"""
SELECT event_id, actual, n_entities, expected, (expected * 10) // 100 AS allowed_delta,
  abs(actual - expected) <= (expected * 10) // 100 AS within
FROM (SELECT event_id, count(*) AS actual, count(DISTINCT skater_id) AS n_entities,
        CAST(count(DISTINCT skater_id) * {60 // _EXP_INTERVAL_S} * {_EXP_MINUTES} AS BIGINT) AS expected
      FROM publish_metrics GROUP BY event_id)""")
def q_expected_count_check(spark, d):
    return G.expected_count_check(ST.publish_metrics(spark, d), None, _EXP_INTERVAL_S, _EXP_MINUTES, 0.1)


def _summary_sql(src: str, key: str, v: str) -> str:
    return f"""
SELECT {key}, count({v}) AS n, min({v}) AS min, round(avg({v}), 3) AS mean, max({v}) AS max,
  quantile_cont({v}, 0.5) AS p50, quantile_cont({v}, 0.95) AS p95, quantile_cont({v}, 0.99) AS p99
FROM {src} GROUP BY {key}"""


def _round_mean(df):
    return df.withColumn("mean", F.round("mean", 3))


@query("response_time_summary", W("publish_metrics") + _summary_sql(
    "(SELECT * FROM publish_metrics WHERE error = '')", "event_id", "response_time_ms"))
def q_response_time_summary(spark, d):
    return _round_mean(G.response_time_summary(ST.publish_metrics(spark, d)))


@query("delivery_latency", W("deliveries") + f"""
SELECT s.*, n_negative FROM ({_summary_sql(
    "(SELECT *, CAST(receive_ms - server_ms AS DOUBLE) AS latency_ms FROM deliveries "
    "WHERE error = '' AND server_ms IS NOT NULL)", "event_id", "latency_ms")}) s
JOIN (SELECT event_id, count_if(receive_ms < server_ms) AS n_negative FROM deliveries
      WHERE error = '' AND server_ms IS NOT NULL GROUP BY event_id) n USING (event_id)""")
def q_delivery_latency(spark, d):
    return _round_mean(G.delivery_latency_summary(ST.deliveries(spark, d)))


@query("batching_delay", W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, GRID]) + f"""
SELECT viewer_id, count(*) AS n, min(window_ms + {BATCH_INTERVAL_MS} - ts_ms) AS min_delay_ms,
  max(window_ms + {BATCH_INTERVAL_MS} - ts_ms) AS max_delay_ms,
  CAST(sum(window_ms + {BATCH_INTERVAL_MS} - ts_ms) AS BIGINT) AS total_delay_ms
FROM grid GROUP BY viewer_id""")
def q_batching_delay(spark, d):
    rows = G.batching_delay(_batches(spark, d), ["viewer_id"])
    return rows.groupBy("viewer_id").agg(F.count(F.lit(1)).alias("n"), F.min("delay_ms").alias("min_delay_ms"),
                                         F.max("delay_ms").alias("max_delay_ms"),
                                         F.sum("delay_ms").alias("total_delay_ms"))


@query("publish_to_delivery", W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, GRID]) + f"""
SELECT g.viewer_id, u.event_id, u.entity_id, u.ts_ms, u.seq, g.window_ms + {BATCH_INTERVAL_MS} AS delivered_ms,
  g.window_ms + {BATCH_INTERVAL_MS} - u.ts_ms AS delay_ms
FROM updates u JOIN grid g ON u.event_id = g.event_id AND u.entity_id = g.entity_id AND u.ts_ms = g.ts_ms""")
def q_publish_to_delivery(spark, d):
    delivered = G.explode_locations(_batches(spark, d), ["viewer_id", "event_id"])
    return G.publish_to_delivery(_updates(spark, d), delivered).select(
        "viewer_id", "event_id", "entity_id", "ts_ms", "seq", "delivered_ms", "delay_ms")


@query("publish_rate", W("updates") + f"""
SELECT event_id, {Q.grid_floor('ts_ms', ORIGIN_MS, HOUR_MS)} AS window_ms, count(*) AS n_updates,
  count(*) * 60000e0 / {float(HOUR_MS)!r}e0 AS per_minute
FROM updates GROUP BY 1, 2""".replace(".0e0", "e0"))
def q_publish_rate(spark, d):
    return G.publish_rate(_updates(spark, d), HOUR_MS, ORIGIN_MS)


def _gc(x: str) -> str:
    return Q.grid_ceil(x, ORIGIN_MS, LOC_SWEEP_MS)


@query("active_gauges", W("updates", "viewers", extra=[VERSIONS, PRESENCE, ("deltas", f"""
SELECT {_gc('present_from_ms')} AS t_ms, 1 AS de, 0 AS dn, 0 AS dv FROM presence
UNION ALL SELECT {_gc('removed_at_ms')}, -1, 0, 0 FROM presence WHERE removed_at_ms IS NOT NULL
UNION ALL SELECT {_gc('ts_ms')}, 0, 1, 0 FROM (SELECT *, lag(rs) OVER (PARTITION BY event_id, entity_id ORDER BY ts_ms, seq) AS prs FROM versions) WHERE prs IS NULL OR ts_ms > prs
UNION ALL SELECT {_gc('removed_at_ms')}, 0, -1, 0 FROM versions WHERE removed_at_ms IS NOT NULL
UNION ALL SELECT {_gc('subscribed_ms')}, 0, 0, 1 FROM viewers
UNION ALL SELECT {_gc('left_ms')}, 0, 0, -1 FROM viewers WHERE left_ms IS NOT NULL""")]) + """
SELECT t_ms,
  CAST(sum(de) OVER (ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active_events,
  CAST(sum(dn) OVER (ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live_entities,
  CAST(sum(dv) OVER (ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open_viewers
FROM (SELECT t_ms, sum(de) AS de, sum(dn) AS dn, sum(dv) AS dv FROM deltas GROUP BY t_ms)""")
def q_active_gauges(spark, d):
    u = _updates_once(spark, d)
    points = cut(C.lifetime_points(u, LOC_TTL_MS, LOC_SWEEP_MS, ORIGIN_MS), "points")
    return G.active_gauges(C.presence_points(points), points, ST.viewers(spark, d), LOC_SWEEP_MS, ORIGIN_MS)


_EDGES = [0.0, 100.0, 250.0, 500.0, 1000.0, 2500.0]


@query("duration_histogram", W("deliveries") + f"""
SELECT bucket, list_extract([NULL, {", ".join(f"{e!r}e0".replace(".0e0", "e0") for e in _EDGES)}]::DOUBLE[], bucket + 1) AS lower,
  list_extract([{", ".join(f"{e!r}e0".replace(".0e0", "e0") for e in _EDGES)}, NULL]::DOUBLE[], bucket + 1) AS upper, count(*) AS n
FROM (SELECT {" + ".join(f"CAST(latency_ms >= {e!r}e0 AS INTEGER)".replace(".0e0", "e0") for e in _EDGES)} AS bucket
      FROM (SELECT CAST(receive_ms - server_ms AS DOUBLE) AS latency_ms FROM deliveries
            WHERE error = '' AND server_ms IS NOT NULL))
GROUP BY bucket""")
def q_duration_histogram(spark, d):
    return G.duration_histogram(G.delivery_latency(ST.deliveries(spark, d)), "latency_ms", _EDGES)


@query("bandwidth_estimate", W("updates") + f"""
SELECT event_id, {Q.grid_floor('ts_ms', ORIGIN_MS, HOUR_MS)} AS window_ms, count(*) AS n_updates,
  count(*) * 2048 AS bytes, count(*) * 2048 / 3600e0 AS bytes_per_s
FROM updates GROUP BY 1, 2""")
def q_bandwidth_estimate(spark, d):
    return G.bandwidth_estimate(_updates(spark, d), 2048, HOUR_MS, ORIGIN_MS)


# =========================================================================== H: heap series
from loctrack.operators import timeseries as H  # noqa: E402

_CLK = H.CLOCK_RE
_CLOCK_V = (f"CASE WHEN regexp_full_match(time_str, '{_CLK[1:-1]}') "
            f"AND CAST(regexp_extract(time_str, '{_CLK}', 1) AS INTEGER) < 24 "
            f"AND CAST(regexp_extract(time_str, '{_CLK}', 2) AS INTEGER) < 60 "
            f"AND CAST(regexp_extract(time_str, '{_CLK}', 3) AS INTEGER) <= 61 THEN "
            f"CAST(CAST(regexp_extract(time_str, '{_CLK}', 1) AS INTEGER) * 3600 "
            f"+ CAST(regexp_extract(time_str, '{_CLK}', 2) AS INTEGER) * 60 "
            f"+ CAST(regexp_extract(time_str, '{_CLK}', 3) AS INTEGER) AS DOUBLE) "
            f"+ CAST('0.' || regexp_extract(time_str, '{_CLK}', 4) AS DOUBLE) END")
ELAPSED = ("elapsed", f"""
SELECT recording, sample_no, time_str, heap_mb, elapsed_s FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY recording ORDER BY sample_no) - 1 AS DOUBLE) AS elapsed_s
  FROM hs WHERE first_v IS NULL)
UNION ALL
SELECT recording, sample_no, time_str, heap_mb, v - first_v + days * 86400e0 AS elapsed_s FROM (
  SELECT *, sum(back) OVER (PARTITION BY recording ORDER BY sample_no ROWS UNBOUNDED PRECEDING) AS days FROM (
    SELECT *, CASE WHEN lag(v) OVER (PARTITION BY recording ORDER BY sample_no) > v THEN 1 ELSE 0 END AS back
    FROM hs WHERE first_v IS NOT NULL AND v IS NOT NULL))""")
HS = ("hs", f"""
SELECT *, first_value(v) OVER (PARTITION BY recording ORDER BY sample_no
                               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_v
FROM (SELECT *, {_CLOCK_V} AS v FROM heap_series)""")


def _elapsed(spark, d):
    return H.elapsed_seconds(ST.heap_series(spark, d))


@query("heap_elapsed", W("heap_series", extra=[HS, ELAPSED]) + "SELECT * FROM elapsed")
def q_heap_elapsed(spark, d):
    return _elapsed(spark, d)


SUMMARY = ("summary", """
SELECT recording, count(*) AS n_samples, arg_max(elapsed_s, sample_no) / 60 AS duration_min,
  arg_min(heap_mb, sample_no) AS initial_mb, arg_max(heap_mb, sample_no) AS final_mb,
  arg_max(heap_mb, sample_no) - arg_min(heap_mb, sample_no) AS growth_mb,
  coalesce(regr_slope(heap_mb, elapsed_s), 0) * 60 AS rate
FROM elapsed GROUP BY recording""")


@query("heap_summary", W("heap_series", extra=[HS, ELAPSED, SUMMARY]) + f"""
SELECT recording, n_samples, duration_min, initial_mb, final_mb, growth_mb, round(rate, 3) + 0e0 AS growth_mb_per_min,
  CASE WHEN rate > {H.S.LEAK_MB_PER_MIN} THEN 'LEAK' WHEN rate > {H.S.POTENTIAL_LEAK_MB_PER_MIN} THEN 'POTENTIAL_LEAK'
       ELSE 'STABLE' END AS assessment
FROM summary""")
def q_heap_summary(spark, d):
    # + 0.0 turns a rounded -0.0 into 0.0
    return H.recording_summary(_elapsed(spark, d)) \
        .withColumn("growth_mb_per_min", F.round("growth_mb_per_min", 3) + F.lit(0.0))


@query("heap_compare", W("heap_series", extra=[HS, ELAPSED, SUMMARY]) + """
SELECT base, rate_a, rate_b, round(CASE WHEN rate_a <> 0 THEN (rate_b - rate_a) / abs(rate_a) * 100 END, 3) AS change_pct
FROM (SELECT split_part(recording, '/', 1) AS base,
        CASE WHEN duration_min > 0 THEN (final_mb - initial_mb) / duration_min END AS rate_a
      FROM summary WHERE ends_with(recording, '/a')) a
JOIN (SELECT split_part(recording, '/', 1) AS base,
        CASE WHEN duration_min > 0 THEN (final_mb - initial_mb) / duration_min END AS rate_b
      FROM summary WHERE ends_with(recording, '/b')) b USING (base)""")
def q_heap_compare(spark, d):
    s = H.recording_summary(_elapsed(spark, d)).withColumn("base", F.split("recording", "/")[0])
    a = s.filter(F.col("recording").endswith("/a"))
    b = s.filter(F.col("recording").endswith("/b"))
    return H.compare_runs(a, b, "base").withColumn("change_pct", F.round("change_pct", 3))


# =========================================================================== I: logs
from loctrack.operators import logs as I  # noqa: E402

_LRE = I.LINE_RE
PARSED = ("parsed", f"""
SELECT line_no, line, CASE WHEN regexp_matches(line, '{_LRE}') THEN regexp_extract(line, '{_LRE}', 1) END AS time_text,
  CASE WHEN regexp_matches(line, '{_LRE}') THEN regexp_extract(line, '{_LRE}', 2) END AS level,
  CASE WHEN regexp_matches(line, '{_LRE}') THEN regexp_extract(line, '{_LRE}', 3) END AS logger,
  CASE WHEN regexp_matches(line, '{_LRE}') THEN regexp_extract(line, '{_LRE}', 4) ELSE line END AS message
FROM log_lines""")
PARSED_TS = ("parsed_ts", "SELECT *, epoch_us(strptime(time_text, '%Y-%m-%d %H:%M:%S')) // 1000 AS ts_ms FROM parsed")


def _logs(spark, d):
    return I.parse_log_lines(ST.log_lines(spark, d))


@query("log_parse", W("log_lines", extra=[PARSED, PARSED_TS]) + """
SELECT line_no, time_text, ts_ms, level, logger, message FROM parsed_ts""")
def q_log_parse(spark, d):
    return _logs(spark, d).select("line_no", "time_text", "ts_ms", "level", "logger", "message")


_CRASH_SQL = ("CASE " + " ".join(f"WHEN contains(line, '{w}') THEN '{w}'" for w in I.S.CRASH_INDICATORS)
              + " WHEN len(list_filter(regexp_extract_all(line, 'exit code ([0-9]+)', 1), lambda c: c <> '0')) > 0"
              + " THEN 'exit code ' || list_filter(regexp_extract_all(line, 'exit code ([0-9]+)', 1), lambda c: c <> '0')[1]"
              + " END")


@query("crash_scan", W("log_lines") + f"""
SELECT line_no, crash_reason FROM (SELECT line_no, {_CRASH_SQL} AS crash_reason FROM log_lines)
WHERE crash_reason IS NOT NULL""")
def q_crash_scan(spark, d):
    return I.crash_scan(_logs(spark, d)).select("line_no", "crash_reason")


@query("crash_scan_tail", W("log_lines") + f"""
SELECT line_no, crash_reason FROM (SELECT line_no, {_CRASH_SQL} AS crash_reason FROM
  (SELECT * FROM log_lines ORDER BY line_no DESC LIMIT 200))
WHERE crash_reason IS NOT NULL""")
def q_crash_scan_tail(spark, d):
    return I.crash_scan(_logs(spark, d), tail=200).select("line_no", "crash_reason")


@query("sweep_log", W("log_lines", extra=[PARSED, PARSED_TS]) + f"""
SELECT kind, ts_ms - (ts_ms % {HOUR_MS}) AS period_ms, count(*) AS n_sweeps,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS n_removed, count_if(failed) AS n_failed
FROM (SELECT ts_ms,
        CASE WHEN regexp_matches(message, '{I.SWEEP_HUBS_RE}') OR starts_with(message, 'Hub cleanup failed: ') THEN 'hubs'
             WHEN regexp_matches(message, '{I.SWEEP_LOCATIONS_RE}') OR starts_with(message, 'Cleanup failed: ') THEN 'locations' END AS kind,
        CASE WHEN regexp_matches(message, '{I.SWEEP_HUBS_RE}') THEN CAST(regexp_extract(message, '{I.SWEEP_HUBS_RE}', 1) AS BIGINT)
             WHEN regexp_matches(message, '{I.SWEEP_LOCATIONS_RE}') THEN CAST(regexp_extract(message, '{I.SWEEP_LOCATIONS_RE}', 1) AS BIGINT) END AS n,
        starts_with(message, 'Hub cleanup failed: ') OR starts_with(message, 'Cleanup failed: ') AS failed
      FROM parsed_ts)
WHERE kind IS NOT NULL GROUP BY 1, 2""")
def q_sweep_log(spark, d):
    return I.sweep_totals(I.sweep_log(_logs(spark, d)), HOUR_MS)


@query("logs_for_event", W("log_lines", extra=[PARSED, PARSED_TS]) + f"""
SELECT * FROM (
  SELECT line_no, ts_ms,
    CASE WHEN regexp_matches(message, '{I.REQUEST_RE}') THEN 'request' WHEN regexp_matches(message, '{I.CONNECT_RE}') THEN 'connect'
         WHEN regexp_matches(message, '{I.REJECT_RE}') THEN 'reject' WHEN regexp_matches(message, '{I.STREAM_ERROR_RE}') THEN 'stream_error' END AS kind,
    CASE WHEN regexp_matches(message, '{I.REQUEST_RE}') THEN regexp_extract(message, '{I.REQUEST_RE}', 1)
         WHEN regexp_matches(message, '{I.CONNECT_RE}') THEN regexp_extract(message, '{I.CONNECT_RE}', 1)
         WHEN regexp_matches(message, '{I.STREAM_ERROR_RE}') THEN regexp_extract(message, '{I.STREAM_ERROR_RE}', 1) END AS event_id,
    CASE WHEN regexp_matches(message, '{I.REQUEST_RE}') THEN regexp_extract(message, '{I.REQUEST_RE}', 2) END AS entity_id,
    CASE WHEN regexp_matches(message, '{I.REJECT_RE}') THEN regexp_extract(message, '{I.REJECT_RE}', 1) END AS error_code
  FROM parsed_ts)
WHERE event_id IN ('{_uuid_of('click')}', '{_uuid_of('view')}')""")
def q_logs_for_event(spark, d):
    return I.logs_for_event(_logs(spark, d), _TWO_EVENTS)


# =========================================================================== A: codecs on derived data
from loctrack import sources as A  # noqa: E402


@query("batch_json_roundtrip", W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, GRID]) + f"""
SELECT viewer_id, window_ms, batch_no, CAST(pos AS INTEGER) AS pos, entity_id AS skaterId, latitude, longitude,
  ts_ms AS timestamp, window_ms + {BATCH_INTERVAL_MS} AS serverTime, CAST(NULL AS VARCHAR) AS decode_error
FROM grid""")
def q_batch_json_roundtrip(spark, d):
    b = _batches(spark, d)
    text = b.select("viewer_id", "window_ms", "batch_no", A.batches_to_json(b).alias("json"))
    return A.explode_batches(text, "json", keep=["viewer_id", "window_ms", "batch_no"])


@query("flat_update_roundtrip", W("updates") + """
SELECT event_id AS eventId, entity_id AS skaterId, longitude, latitude, ts_ms AS timestamp, seq,
  CAST(NULL AS VARCHAR) AS decode_error FROM updates""")
def q_flat_update_roundtrip(spark, d):
    u = _updates(spark, d)
    js = F.to_json(F.struct(F.col("event_id").alias("eventId"), F.col("entity_id").alias("skaterId"),
                            "longitude", "latitude", F.col("ts_ms").alias("timestamp")))
    t = u.select("seq", js.alias("json"))
    return A.parse_flat_updates(t, "json", now_ms=0).drop("json")


@query("publish_metrics_text", W("publish_metrics") + """
SELECT strftime(make_timestamp((ts_ms // 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, event_id, skater_id,
  printf('%.2f', response_time_ms) AS response_time_ms, error FROM publish_metrics""")
def q_publish_metrics_text(spark, d):
    return A.publish_metrics_text(ST.publish_metrics(spark, d))


# =========================================================================== A: files written and read again
def _folder(spark, name: str) -> str:
    import uuid

    from loctrack.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex[:12]}"


@query("raw_update_files", W("updates_raw") + _VALIDATE_RAW_SQL)
def q_raw_update_files(spark, d):
    """A1: requests written as JSON lines and read again, then validated."""
    path = _folder(spark, "raw")
    ST.raw_requests(spark, d).write.json(path)
    return V.validate_updates(A.read_raw_updates(spark, path)).select("seq", "event_id", "entity_id", "error_code")


_RFC = "strftime(make_timestamp((ts_ms // 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


@query("publish_metric_files", W("publish_metrics") + f"""
SELECT (ts_ms // 1000) * 1000 AS ts_ms, event_id, skater_id, printf('%.2f', response_time_ms)::DOUBLE AS response_time_ms, error
FROM publish_metrics""")
def q_publish_metric_files(spark, d):
    """Publish CSV written and read again."""
    path = _folder(spark, "publish")
    A.write_publish_metrics(ST.publish_metrics(spark, d), path)
    return A.read_publish_metrics(spark, path).select("ts_ms", "event_id", "skater_id", F.col("response_time_ms").cast("double").alias("response_time_ms"), "error")


@query("delivery_metric_files", W("deliveries") + """
SELECT (receive_ms // 1000) * 1000 AS ts_ms, event_id, viewer_number, seq AS message_count,
  printf('%.2f', coalesce(receive_ms - server_ms, 0)::DOUBLE)::DOUBLE AS latency_ms, skater_ids, error,
  len(list_filter(string_split(skater_ids, '|'), lambda x: trim(x) <> '')) AS n_ids
FROM deliveries""")
def q_delivery_metric_files(spark, d):
    """Delivery CSV written and read again."""
    path = _folder(spark, "delivery")
    rows = ST.deliveries(spark, d)
    A.write_delivery_metrics(rows.select(F.col("receive_ms").alias("ts_ms"), "event_id", "viewer_number", F.col("seq").alias("message_count"),
                                         F.coalesce(F.col("receive_ms") - F.col("server_ms"), F.lit(0)).cast("double").alias("latency_ms"),
                                         "skater_ids", "error"), path)
    return A.read_delivery_metrics(spark, path).select(
        "ts_ms", "event_id", F.col("viewer_number").cast("int").alias("viewer_number"), F.col("message_count").cast("long").alias("message_count"),
        F.col("latency_ms").cast("double").alias("latency_ms"), "skater_ids", "error", F.size("skater_id_list").cast("long").alias("n_ids"))


@query("app_log_files", W("log_lines", extra=[PARSED]) + """
SELECT level, logger, message, count(*) AS n, (SELECT count(*) FROM log_lines) AS n_numbered FROM parsed GROUP BY 1, 2, 3""")
def q_app_log_files(spark, d):
    """A10: log files written and read again; ``n_numbered`` counts the distinct
    (file, line number) pairs with numbers below the file's line count."""
    path = _folder(spark, "logs")
    ST.log_lines(spark, d).select("line").write.text(path)
    logs = A.read_app_logs(spark, path)
    per = logs.groupBy("source_file").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("line_no").alias("u"), F.max("line_no").alias("m"))
    good = per.filter((F.col("k") == F.col("u")) & (F.col("m") == F.col("k") - 1)).agg(F.sum("k").alias("n_numbered"))
    return logs.groupBy("level", "logger", "message").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(good))


@query("heap_recording_files", W("heap_series") + """
SELECT time_str, round(heap_mb, 3) AS heap_mb, count(*) AS n FROM heap_series GROUP BY ALL""")
def q_heap_recording_files(spark, d):
    """Recordings written as text blocks, read again and parsed."""
    path = _folder(spark, "heap")
    block = F.format_string("jdk.GCHeapSummary {\n  startTime = %s (2026-01-18)\n  heapUsed = %.3f MB\n}", "time_str", "heap_mb")
    ST.heap_series(spark, d).select(block.alias("value")).write.text(path)
    s = H.heap_samples(A.read_heap_recordings(spark, path))
    return s.groupBy("time_str", F.round("heap_mb", 3).alias("heap_mb")).agg(F.count(F.lit(1)).alias("n"))


# Messages of which most are broken in one way, by the row's number.
_MESSAGES = """CASE seq % 9 WHEN 0 THEN '[1,2]' WHEN 1 THEN '{"locations":"no","serverTime":5}'
  WHEN 2 THEN concat('{"locations":[{"skaterId":7,"latitude":1,"longitude":2,"timestamp":3}],"serverTime":', CAST(ts_ms AS {s}), '}')
  WHEN 3 THEN concat('{"locations":[{"skaterId":"a","latitude":"x","longitude":2,"timestamp":3}],"serverTime":', CAST(ts_ms AS {s}), '}')
  WHEN 4 THEN '{"locations":[],"serverTime":"5"}' WHEN 5 THEN 'not json'
  WHEN 6 THEN concat('{"serverTime":', CAST(ts_ms AS {s}), ',"locations":[{"skaterId":"a","latitude":1,"longitude":2,"timestamp":1.5}]}')
  ELSE concat('{"locations":[{"skaterId":"', entity_id, '","latitude":1.5,"longitude":2,"timestamp":', CAST(ts_ms AS {s}),
    '},{"skaterId":"b"}],"serverTime":', CAST(ts_ms AS {s}), '}') END"""


@query("mistyped_messages", W("updates") + """
SELECT seq, CAST(NULL AS BIGINT) AS "serverTime", CAST(NULL AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS "skaterId",
  CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS BIGINT) AS "timestamp",
  'failed to parse message' AS decode_error FROM updates WHERE seq % 9 < 7
UNION ALL SELECT seq, ts_ms, 0, entity_id, 1.5, 2, ts_ms, NULL FROM updates WHERE seq % 9 >= 7
UNION ALL SELECT seq, ts_ms, 1, 'b', NULL, NULL, NULL, NULL FROM updates WHERE seq % 9 >= 7""")
def q_mistyped_messages(spark, d):
    """A4 on good and mistyped messages."""
    return A.explode_batches(_updates(spark, d).select("seq", F.expr(_MESSAGES.replace("{s}", "STRING")).alias("json")), "json", keep=["seq"])


# Null keys, NaN and infinite values, by the row's number.
@query("value_summary_odd", W("publish_metrics") + """
, odd AS (SELECT nullif(event_id, '3') AS event_id, CASE WHEN CAST(skater_id AS BIGINT) % 11 = 0 THEN 'NaN'::DOUBLE ELSE response_time_ms END AS v FROM publish_metrics)
SELECT event_id, count(v) AS n, min(v) AS min, quantile_cont(v, 0.5) AS p50, quantile_disc(v, 1) AS max FROM odd GROUP BY event_id
UNION ALL SELECT 'all', count(v), min(v), quantile_cont(v, 0.5), quantile_disc(v, 1) FROM odd""")
def q_value_summary_odd(spark, d):
    """G5 with a null key, NaN values, and without keys."""
    m = ST.publish_metrics(spark, d).select(
        F.nullif("event_id", F.lit("3")).alias("event_id"),
        F.when(F.col("skater_id").cast("long") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("response_time_ms")).alias("v"))
    cols = ["event_id", "n", "min", "p50", "max"]
    return G.value_summary(m, ["event_id"], "v").select(*cols).unionByName(
        G.value_summary(m, [], "v").withColumn("event_id", F.lit("all")).select(*cols))


@query("heap_elapsed_iso", W("heap_series") + """
SELECT recording, sample_no, v - min(v) OVER (PARTITION BY recording) AS elapsed_us
FROM (SELECT h.recording, h.sample_no, epoch_us(e.ts) AS v FROM heap_series h JOIN events e ON e.event_id = h.sample_no)""")
def q_heap_elapsed_iso(spark, d):
    """H2 on ISO times."""
    ev = ST._events(spark, d).select(F.col("event_id").alias("sample_no"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time_str"))
    s = ST.heap_series(spark, d).drop("time_str").join(ev, "sample_no")
    return H.elapsed_seconds(s).select("recording", "sample_no", F.round(F.col("elapsed_s") * 1e6).cast("long").alias("elapsed_us"))


# =========================================================================== K: streaming
_WM_MS = 1000                            # watermark delay of the streams
# A replay has at least this many micro-batches, and more if one would hold more rows.
_REPLAY_BATCHES, _REPLAY_ROWS, _REPLAY_FILE_ROWS = 6, 5_000_000, 500_000


def _replay(spark, src: DataFrame, name: str, time_col: str, run) -> str:
    """Replay a derived table as a stream, in order of ``time_col``.

    The table is written under the shared checkpoint folder, then dealt in time
    slices to an input folder, one after the other, so that the file source
    takes them in order; each slice is one micro-batch.  ``run(stream, base)``
    starts the query, which is run to the end of input (``availableNow``).
    Returns the folder."""
    import uuid

    from loctrack.session import checkpoint_dir
    base = f"{checkpoint_dir(spark).rstrip('/')}/replay/{name}-{uuid.uuid4().hex[:12]}"
    src.write.parquet(f"{base}/table")
    table = spark.read.schema(src.schema).parquet(f"{base}/table")
    n, lo, hi = table.agg(F.count(F.lit(1)), F.min(time_col), F.max(time_col)).first()
    batches = max(_REPLAY_BATCHES, n // _REPLAY_ROWS)
    files = n // batches // _REPLAY_FILE_ROWS + 1
    step = ((hi or 0) - (lo or 0)) // batches + 1
    for i in range(batches):
        at = (lo or 0) + i * step
        table.filter((F.col(time_col) >= at) & (F.col(time_col) < at + step)) \
            .repartition(files).write.mode("append").parquet(f"{base}/input")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/input")
    run(stream, base).awaitTermination()
    return base


def _replay_rows(spark, src: DataFrame, name: str, time_col: str, build, mode: str = "append") -> DataFrame:
    """``_replay`` into a parquet sink with a folder for each micro-batch (a
    replayed batch overwrites its own); the sink as a batch DataFrame."""
    from loctrack.streaming import stream_checkpoint

    def run(stream, base):
        out = build(stream)
        schemas.append(out.schema)

        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

        return out.writeStream.foreachBatch(sink).outputMode(mode) \
            .option("checkpointLocation", stream_checkpoint(spark, name)).trigger(availableNow=True).start()

    schemas: list = []
    base = _replay(spark, src, name, time_col, run)
    return spark.read.schema(schemas[0]).parquet(f"{base}/out/*")


@query("latest_state_stream", W("updates") + f"""
SELECT event_id, entity_id, longitude, latitude, ts_ms, seq,
  CASE WHEN ts_ms + {_TTL_S} < (SELECT max(ts_ms) - {_WM_MS} FROM updates) THEN 'remove' ELSE 'upsert' END AS change
FROM ({_LATEST_SQL.format(src="updates")})""")
def q_latest_state_stream(spark, d):
    """The last change of every key; earlier changes depend on the micro-batches."""
    from loctrack import streaming as K
    u = _updates(spark, d).select("event_id", "entity_id", "longitude", "latitude", "seq", "ts_ms")
    out = _replay_rows(spark, u, "latest_state_stream", "ts_ms",
                       lambda s: K.latest_state_stream(s, LOC_TTL_MS, _WM_MS, emit_removals=True), "update")
    vals = ["longitude", "latitude", "ts_ms", "seq", "change"]
    last = F.max_by(F.struct(*vals), F.struct("ts_ms", "seq", F.col("change") == "remove"))
    return out.groupBy("event_id", "entity_id").agg(last.alias("_v")).select("event_id", "entity_id", "_v.*")


@query("group_within_stream", "WITH RECURSIVE " + W(*_STREAM_VIEWS, extra=[*_STREAM_EXTRA, NEXT_OPEN, OPENS]).removeprefix("WITH ") + f"""
, groups AS (SELECT CAST(s.viewer_id AS VARCHAR) AS key, o.group_no, o.open_ms AS group_open_ms, count(*) AS n_rows,
    min(s.msg_no) AS first_msg, max(s.msg_no) AS last_msg, o.nxt
  FROM stream s JOIN opens o ON s.viewer_id = o.viewer_id AND s.msg_no >= o.i AND s.msg_no < o.nxt GROUP BY ALL)
SELECT key, group_no, group_open_ms, n_rows, first_msg, last_msg FROM groups g
WHERE n_rows = {BATCH_SIZE} OR group_open_ms + {BATCH_INTERVAL_MS} < (SELECT max(deliver_ms) - {_WM_MS} FROM stream)
  OR EXISTS (SELECT 1 FROM groups h WHERE h.key = g.key AND h.group_no > g.group_no)""")
def q_group_within_stream(spark, d):
    """Every group that is closed at the end of input."""
    from loctrack import streaming as K
    rows = _stream(spark, d).select(F.col("viewer_id").cast("string").alias("viewer_id"), "msg_no", "deliver_ms")
    return _replay_rows(spark, rows, "group_within_stream", "deliver_ms",
                        lambda s: K.group_within_stream(s, "viewer_id", BATCH_SIZE, BATCH_INTERVAL_MS, ts="deliver_ms",
                                                        watermark_ms=_WM_MS, keep_ms=400 * DAY_MS))


@query("channel_sessions_stream", W("accesses") + f"""
SELECT event_id, started_ms, last_access_ms, n_accesses, removed_at_ms FROM (
{_sessions_sql(lambda x: f"({x} + {CHAN_TTL_MS})")}) WHERE removed_at_ms <= (SELECT max(access_ms) - {_WM_MS} FROM accesses)""")
def q_channel_sessions_stream(spark, d):
    """Every session that is closed at the end of input."""
    from loctrack import streaming as K
    return _replay_rows(spark, ST.accesses(spark, d), "channel_sessions_stream", "access_ms",
                        lambda s: K.channel_sessions_stream(s, CHAN_TTL_MS, _WM_MS))


@query("publish_rate_stream", W("updates") + f"""
SELECT event_id, ts_ms - ts_ms % {HOUR_MS} AS window_ms, count(*) AS n_updates FROM updates GROUP BY 1, 2
HAVING window_ms + {HOUR_MS} <= (SELECT max(ts_ms) - {_WM_MS} FROM updates)""")
def q_publish_rate_stream(spark, d):
    """Every window that is closed at the end of input."""
    from loctrack import streaming as K
    u = _updates(spark, d).select("event_id", "entity_id", "seq", "ts_ms")
    return _replay_rows(spark, u, "publish_rate_stream", "ts_ms", lambda s: K.publish_rate_stream(s, HOUR_MS, _WM_MS))


@query("fan_out_stream", W("updates", "viewers", extra=[FANOUT]) + "SELECT * FROM fanout")
def q_fan_out_stream(spark, d):
    from loctrack import streaming as K
    return _replay_rows(spark, _updates(spark, d), "fan_out_stream", "ts_ms",
                        lambda s: K.fan_out_stream(s, ST.viewers(spark, d)))


@query("ingest_stream", W("updates_raw") + """
SELECT seq, event_id, entity_id, coalesce(error_code, '') AS error FROM (""" + _VALIDATE_RAW_SQL + ")")
def q_ingest_stream(spark, d):
    """Both sinks of the ingest, accepted rows without an error."""
    from loctrack import streaming as K
    raw = ST.raw_requests(spark, d)
    base = _replay(spark, raw, "ingest_stream", "received_ms", lambda s, base: K.ingest_stream(
        s, f"{base}/accepted", f"{base}/rejected", K.stream_checkpoint(spark, "ingest_stream")))
    acc = spark.read.parquet(f"{base}/accepted").select("seq", "event_id", "entity_id", F.lit("").alias("error"))
    return acc.unionByName(spark.read.parquet(f"{base}/rejected").select("seq", "event_id", "entity_id", "error"))


@query("newest_n_stream", W("updates") + f"""
SELECT event_id, entity_id, longitude, latitude, ts_ms, seq, n_dropped FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts_ms DESC, seq DESC) AS rn,
    greatest(count(*) OVER (PARTITION BY event_id) - {NEWEST_N}, 0) AS n_dropped FROM updates)
WHERE rn <= {NEWEST_N}""")
def q_newest_n_stream(spark, d):
    """The buffer at the end of input, and how many rows of the key it has dropped."""
    from loctrack import streaming as K
    base = _replay(spark, _updates(spark, d), "newest_n_stream", "ts_ms", lambda s, base: K.newest_n_stream(
        s, NEWEST_N, f"{base}/kept", f"{base}/dropped", K.stream_checkpoint(spark, "newest_n_stream")))
    kept = spark.read.parquet(f"{base}/kept")
    dropped = spark.read.parquet(f"{base}/dropped/*")
    last = dropped.agg(F.max("batch_id")).first()[0]
    n = dropped.groupBy("event_id").agg(F.sum("n_dropped").alias("n_dropped"))
    return kept.filter(F.col("batch_id") == (last or 0)).drop("batch_id").join(n, "event_id")


def queries() -> dict[str, QueryFn]:
    from loctrack.plans import live  # noqa: F401  registers more
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from loctrack.plans import live  # noqa: F401
    return dict(ORACLES)
