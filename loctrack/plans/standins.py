"""Stand-in tables derived from the driver tables (``events``, ``nation``).

The reference has no tables of its own; these rules turn the driver's synthetic
``events`` (timestamped rows per user and type) into the records the reference
handles: raw location requests, accepted updates, viewers, channel accesses,
publish and delivery metrics, heap samples and service log lines.  Every table
is derived by Spark from the given parquet files, so the work grows with them.
Each rule exists twice: as a DataFrame (``build``) and as DuckDB SQL (``SQL``).
"""

from __future__ import annotations

from datetime import datetime, timedelta
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loctrack.functions import epoch_ms_ntz, uuid_from_hex
from loctrack.operators.validate import split_valid, validate_updates
from loctrack.plans import sqltext as Q
from loctrack.session import use_utc

# Fixed values of the stand-in rules.
DAY_MS = 86_400_000
HOUR_MS = 3_600_000
ORIGIN_MS = 1_704_067_200_000          # 2024-01-01 00:00:00 UTC, grid origin
SNAPSHOT_AT_MS = 1_705_312_800_000     # 2024-01-15 10:00:00 UTC
VIEWERS_FROM_MS = 1_704_153_600_000    # 2024-01-02 00:00:00 UTC
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _uuid_of_type(event_type: str) -> str:
    """The event id that the stand-ins derive from an event type."""
    h = md5(event_type.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir, until_ms: int | None = None) -> DataFrame:
    """``until_ms`` filters on the stored time, so that it reaches the scan."""
    use_utc(spark)
    ev = _read(spark, sf_dir, "events")
    if until_ms is not None:
        ev = ev.filter(F.col("ts") < F.lit(datetime(1970, 1, 1) + timedelta(milliseconds=until_ms + 1)))
    return ev.withColumn("ts_ms", epoch_ms_ntz("ts"))


def _pick(c: Column, cases: list[tuple[int, object]], default) -> Column:
    out = None
    for m, v in cases:
        cond = (F.col("event_id") % m) == 0
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default)


# --------------------------------------------------------------------------- updates_raw
def updates_raw(spark, sf_dir, until_ms: int | None = None) -> DataFrame:
    """seq, grp, event_id, entity_id, coordinates array<double>, ts_ms."""
    ev = _events(spark, sf_dir, until_ms)
    lon = F.when(F.col("event_id") % 71 == 0, F.lit(float("nan"))) \
        .otherwise(F.col("value") * F.lit(2.0) - F.lit(180.0))
    k = F.regexp_extract("props", r'"k":\s*(-?[0-9.]+)', 1).cast("double")
    lat = k * F.lit(2.0) - F.lit(95.0)
    n = F.when(F.col("event_id") % 83 == 0, F.lit(None).cast("int")) \
        .when(F.col("event_id") % 79 == 0, F.lit(1)) \
        .when(F.col("event_id") % 73 == 0, F.lit(3)).otherwise(F.lit(2))
    coords = F.when(n == 2, F.array(lon, lat)).when(n == 1, F.array(lon)) \
        .when(n == 3, F.array(lon, lat, F.lit(0.0)))
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("grp"),
        F.when(F.col("event_id") % 97 == 0, F.lit("not-a-uuid"))
         .otherwise(uuid_from_hex(F.md5("event_type"))).alias("event_id"),
        F.when(F.col("event_id") % 89 == 0, F.lit(""))
         .otherwise(uuid_from_hex(F.md5(F.concat(F.lit("u"), F.col("user_id").cast("string")))))
         .alias("entity_id"),
        coords.alias("coordinates"),
        F.col("ts_ms"),
    )


def raw_requests(spark, sf_dir) -> DataFrame:
    """Raw requests as the service receives them: ids, JSON body text, arrival ms.

    The body carries the coordinates array as JSON text ('location' instead of
    'coordinates' when the array is absent); NaN is written as the bare word NaN,
    which no strict JSON parser accepts.
    """
    r = updates_raw(spark, sf_dir)
    nums = F.array_join(F.transform("coordinates", lambda x: x.cast("string")), ", ")
    body = F.when(F.col("coordinates").isNull(), F.lit('{"location": [0.0, 0.0]}')) \
        .otherwise(F.concat(F.lit('{"coordinates": ['), nums, F.lit("]}")))
    return r.select("seq", "event_id", "entity_id", body.alias("body"),
                    F.col("ts_ms").alias("received_ms"))


def updates(spark, sf_dir, until_ms: int | None = None) -> DataFrame:
    """Accepted updates: event_id, entity_id, longitude, latitude, ts_ms, seq."""
    accepted, _ = split_valid(validate_updates(updates_raw(spark, sf_dir, until_ms)))
    return accepted


def viewers(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    sub = F.lit(VIEWERS_FROM_MS) + n * F.lit(DAY_MS)
    return _read(spark, sf_dir, "nation").select(
        n.alias("viewer_id"),
        uuid_from_hex(F.md5(F.element_at(types, (n % 5 + 1).cast("int")))).alias("event_id"),
        sub.alias("subscribed_ms"),
        F.when(n % 4 == 0, F.lit(None).cast("long")).otherwise(sub + F.lit(5 * DAY_MS)).alias("left_ms"),
    )


def accesses(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_type").alias("event_id"),
                                         F.col("ts_ms").alias("access_ms"))


def publish_metrics(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir)
    err = F.when(F.col("event_type") != "error", F.lit("")) \
        .when(F.col("event_id") % 3 == 0, F.lit("unexpected status code: 503")) \
        .when(F.col("event_id") % 3 == 1, F.lit("unexpected status code: 400")) \
        .otherwise(F.lit('Put "http://localhost:9000/x": context deadline exceeded'))
    return ev.select(F.col("ts_ms"),
                     (F.col("user_id") % 7).cast("string").alias("event_id"),
                     F.col("user_id").cast("string").alias("skater_id"),
                     F.col("value").alias("response_time_ms"),
                     err.alias("error"))


def deliveries(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir)
    bad = F.col("event_id") % 50 == 0
    recv = F.col("ts_ms") + F.floor(F.col("value") * F.lit(10.0)).cast("long") - F.lit(50)
    return ev.select(
        recv.alias("receive_ms"),
        F.col("event_type").alias("event_id"),
        (F.col("user_id") % 20).cast("int").alias("viewer_number"),
        F.when(bad, F.lit(None).cast("long")).otherwise(F.col("ts_ms")).alias("server_ms"),
        F.when(bad, F.lit("")).otherwise(F.concat_ws(
            "|", F.col("user_id").cast("string"), (F.col("user_id") + 1).cast("string")))
         .alias("skater_ids"),
        F.when(bad, F.lit("failed to parse message: invalid character 'x'")).otherwise(F.lit(""))
         .alias("error"),
        F.col("event_id").alias("seq"),
    )


def heap_series(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir)
    t = F.when(F.col("event_id") % 37 == 0, F.lit("n/a")) \
        .otherwise(F.date_format("ts", "HH:mm:ss.SSS"))
    run = F.when(F.col("ts_ms") < F.lit(ORIGIN_MS + 15 * DAY_MS), F.lit("a")).otherwise(F.lit("b"))
    return ev.select(F.concat(F.col("event_type"), F.lit("/"), run).alias("recording"),
                     F.col("event_id").alias("sample_no"),
                     t.alias("time_str"), (F.lit(250.0) + F.col("value")).alias("heap_mb"))


def log_lines(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir)
    ev_uuid = uuid_from_hex(F.md5("event_type"))
    ent_uuid = uuid_from_hex(F.md5(F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    m = F.col("event_id") % 10
    # The message texts of the service's log lines.
    text = (
        F.when(m == 0, F.concat(F.lit("INFO  app.core.CleanupService Cleanup completed: removed "),
                                (F.col("user_id") % 4).cast("string"), F.lit(" locations")))
        .when(m == 1, F.concat(F.lit("INFO  app.core.BroadcasterCleanupService Hub cleanup completed: removed "),
                               (F.col("user_id") % 3).cast("string"), F.lit(" hubs")))
        .when(m == 2, F.lit("WARN  app.api.LocationController Validation failed: INVALID_LATITUDE - "
                            "Latitude must be between -90.0 and 90.0"))
        .when(m == 3, F.concat(F.lit("INFO  app.api.LocationController Received location update request for event="),
                               ev_uuid, F.lit(", skater="), ent_uuid))
        .when(m == 4, F.concat(F.lit("INFO  app.api.StreamController WebSocket connection established for event="),
                               ev_uuid))
        .when(m == 5, F.lit("ERROR app.Main Container exited with exit code 137"))
        .when(m == 6, F.lit("INFO  app.Main Process finished with exit code 0"))
        .when(m == 7, F.lit("ERROR app.core.CleanupService Cleanup failed: store unavailable"))
        .when(m == 8, F.lit("WARN  app.Main Heap usage high, deployment restart scheduled"))
        .otherwise(F.lit("INFO  app.Main Request served"))
    )
    return ev.select(F.col("event_id").alias("line_no"),
                     F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), text).alias("line"))


BUILDERS = {
    "updates_raw": updates_raw, "raw_requests": raw_requests, "updates": updates,
    "viewers": viewers, "accesses": accesses, "publish_metrics": publish_metrics,
    "deliveries": deliveries, "heap_series": heap_series, "log_lines": log_lines,
}

# --------------------------------------------------------------------------- SQL twins
_EV = f"SELECT *, {Q.ms_of('ts')} AS ts_ms FROM events"
_EVID = Q.uuid_cut("md5(event_type)")
_ENTID = Q.uuid_cut("md5(concat('u', CAST(user_id AS VARCHAR)))")

SQL = {
    "updates_raw": f"""
SELECT event_id AS seq, event_type AS grp,
  CASE WHEN event_id % 97 = 0 THEN 'not-a-uuid' ELSE {_EVID} END AS event_key,
  CASE WHEN event_id % 89 = 0 THEN '' ELSE {_ENTID} END AS entity_key,
  CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 79 = 0 THEN 1
       WHEN event_id % 73 = 0 THEN 3 ELSE 2 END AS n_coords,
  CASE WHEN event_id % 71 = 0 THEN 'NaN'::DOUBLE ELSE value * 2e0 - 180e0 END AS lon,
  CAST(regexp_extract(props, '"k":\\s*(-?[0-9.]+)', 1) AS DOUBLE) * 2e0 - 95e0 AS lat,
  ts_ms
FROM ({_EV})""",
    "validated": f"""
SELECT seq, grp, event_key AS event_id, entity_key AS entity_id, n_coords, lon, lat, ts_ms,
  CASE WHEN NOT {Q.is_valid_uuid('event_key')} THEN 'INVALID_SKATING_EVENT_ID'
       WHEN NOT {Q.is_valid_uuid('entity_key')} THEN 'INVALID_SKATER_ID'
       WHEN n_coords IS NULL THEN 'MISSING_COORDINATES'
       WHEN n_coords <> 2 THEN 'INVALID_COORDINATES_LENGTH'
       WHEN NOT {Q.in_range('lon', -180.0, 180.0)} THEN 'INVALID_LONGITUDE'
       WHEN NOT {Q.in_range('lat', -90.0, 90.0)} THEN 'INVALID_LATITUDE'
  END AS error_code
FROM updates_raw""",
    "updates": """
SELECT event_id, entity_id, lon AS longitude, lat AS latitude, ts_ms, seq
FROM validated WHERE error_code IS NULL""",
    "viewers": f"""
SELECT CAST(n_nationkey AS BIGINT) AS viewer_id,
  {Q.uuid_cut("md5(['click','error','purchase','signup','view'][n_nationkey % 5 + 1])")} AS event_id,
  {VIEWERS_FROM_MS} + n_nationkey * {DAY_MS} AS subscribed_ms,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE {VIEWERS_FROM_MS} + n_nationkey * {DAY_MS} + {5 * DAY_MS} END AS left_ms
FROM nation""",
    "accesses": f"SELECT event_type AS event_id, ts_ms AS access_ms FROM ({_EV})",
    "publish_metrics": f"""
SELECT ts_ms, CAST(user_id % 7 AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS skater_id,
  value AS response_time_ms,
  CASE WHEN event_type <> 'error' THEN ''
       WHEN event_id % 3 = 0 THEN 'unexpected status code: 503'
       WHEN event_id % 3 = 1 THEN 'unexpected status code: 400'
       ELSE 'Put "http://localhost:9000/x": context deadline exceeded' END AS error
FROM ({_EV})""",
    "deliveries": f"""
SELECT ts_ms + CAST(floor(value * 10e0) AS BIGINT) - 50 AS receive_ms, event_type AS event_id,
  CAST(user_id % 20 AS INTEGER) AS viewer_number,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts_ms END AS server_ms,
  CASE WHEN event_id % 50 = 0 THEN '' ELSE concat_ws('|', CAST(user_id AS VARCHAR), CAST(user_id + 1 AS VARCHAR)) END AS skater_ids,
  CASE WHEN event_id % 50 = 0 THEN 'failed to parse message: invalid character ''x''' ELSE '' END AS error,
  event_id AS seq
FROM ({_EV})""",
    "heap_series": f"""
SELECT event_type || '/' || CASE WHEN {Q.ms_of('ts')} < {ORIGIN_MS + 15 * DAY_MS} THEN 'a' ELSE 'b' END AS recording,
  event_id AS sample_no,
  CASE WHEN event_id % 37 = 0 THEN 'n/a' ELSE strftime(ts, '%H:%M:%S.%g') END AS time_str,
  250e0 + value AS heap_mb
FROM events""",
    "log_lines": f"""
SELECT event_id AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' ||
  CASE event_id % 10
    WHEN 0 THEN 'INFO  app.core.CleanupService Cleanup completed: removed ' || CAST(user_id % 4 AS VARCHAR) || ' locations'
    WHEN 1 THEN 'INFO  app.core.BroadcasterCleanupService Hub cleanup completed: removed ' || CAST(user_id % 3 AS VARCHAR) || ' hubs'
    WHEN 2 THEN 'WARN  app.api.LocationController Validation failed: INVALID_LATITUDE - Latitude must be between -90.0 and 90.0'
    WHEN 3 THEN 'INFO  app.api.LocationController Received location update request for event=' || {_EVID} || ', skater=' || {_ENTID}
    WHEN 4 THEN 'INFO  app.api.StreamController WebSocket connection established for event=' || {_EVID}
    WHEN 5 THEN 'ERROR app.Main Container exited with exit code 137'
    WHEN 6 THEN 'INFO  app.Main Process finished with exit code 0'
    WHEN 7 THEN 'ERROR app.core.CleanupService Cleanup failed: store unavailable'
    WHEN 8 THEN 'WARN  app.Main Heap usage high, deployment restart scheduled'
    ELSE 'INFO  app.Main Request served' END AS line
FROM events""",
}
SQL_ORDER = ["updates_raw", "validated", "updates", "viewers", "accesses", "publish_metrics",
             "deliveries", "heap_series", "log_lines"]
SQL_DEPS = {"validated": ["updates_raw"], "updates": ["updates_raw", "validated"]}


def with_views(*names: str) -> str:
    want = set()
    for n in names:
        want.add(n)
        want.update(SQL_DEPS.get(n, []))
    return Q.with_views(SQL, sorted(want), SQL_ORDER)
