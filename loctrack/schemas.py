"""Schemas and fixed values that must equal the reference's."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Validation error codes, messages and detail fields, in the
# order the checks run (first failure wins).
# ---------------------------------------------------------------------------
ERROR_CODES = [
    ("INVALID_SKATING_EVENT_ID", "Skating event ID must be a valid UUID", None, None),
    ("INVALID_SKATER_ID", "Skater ID must be a valid UUID", None, None),
    ("INVALID_JSON", "Request body must be valid JSON", None, None),
    ("MISSING_COORDINATES", "Request must contain 'coordinates' field with array of numbers", None, None),
    ("INVALID_COORDINATES_LENGTH", "Coordinates array must contain exactly 2 numbers [longitude, latitude]", None, None),
    ("INVALID_LONGITUDE", "Longitude must be between -180.0 and 180.0", "coordinates[0]", "range(-180.0, 180.0)"),
    ("INVALID_LATITUDE", "Latitude must be between -90.0 and 90.0", "coordinates[1]", "range(-90.0, 90.0)"),
]
ERROR_MESSAGE = {c: m for c, m, _, _ in ERROR_CODES}
ERROR_FIELD = {c: f for c, _, f, _ in ERROR_CODES if f}
ERROR_CONSTRAINT = {c: k for c, _, _, k in ERROR_CODES if k}

# Coordinate bounds (inclusive).
LON_MIN, LON_MAX = -180.0, 180.0
LAT_MIN, LAT_MAX = -90.0, 90.0

# Heap growth thresholds in MB/min.
LEAK_MB_PER_MIN = 5.0
POTENTIAL_LEAK_MB_PER_MIN = 1.0

# Words that mark a crash in service logs.
CRASH_INDICATORS = [
    "OutOfMemoryError",
    "java.lang.OutOfMemoryError",
    "killed",
    "deployment restart",
    "crashed",
]

# CSV headers of the load tools.
PUBLISH_COLUMNS = ["timestamp", "event_id", "skater_id", "response_time_ms", "error"]
DELIVERY_COLUMNS = ["timestamp", "event_id", "viewer_number", "message_count", "latency_ms",
                    "skater_ids", "error"]

# Error message prefixes of the load tools (error classes).
ERROR_PREFIXES = [
    "invalid URL",
    "connection failed",
    "failed to set read deadline",
    "connection error",
    "failed to parse message",
    "unexpected status code",
]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
RAW_UPDATES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("received_ms", T.LongType()),
])

UPDATES = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("seq", T.LongType()),
])

LOCATION = T.StructType([
    T.StructField("skaterId", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])

BATCH = T.StructType([
    T.StructField("locations", T.ArrayType(LOCATION)),
    T.StructField("serverTime", T.LongType()),
])

FLAT_UPDATE = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("skaterId", T.StringType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])

VIEWERS = T.StructType([
    T.StructField("viewer_id", T.LongType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("subscribed_ms", T.LongType()),
    T.StructField("left_ms", T.LongType()),
])

ACCESSES = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("access_ms", T.LongType()),
])

PUBLISH_METRICS = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("skater_id", T.StringType()),
    T.StructField("response_time_ms", T.DoubleType()),
    T.StructField("error", T.StringType()),
])

DELIVERY_METRICS = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("viewer_number", T.IntegerType()),
    T.StructField("message_count", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("skater_ids", T.StringType()),
    T.StructField("error", T.StringType()),
])
