"""Validation: literal cases of the reference's specs (UUIDs, bounds, bodies, payloads)."""

import json
import math

from pyspark.sql import functions as F

from loctrack.functions import in_range, is_valid_uuid
from loctrack.operators import validate as V

E = "550e8400-e29b-41d4-a716-446655440000"
S = "550e8400-e29b-41d4-a716-446655440001"

VALID = ["550e8400-e29b-41d4-a716-446655440000", "6ba7b810-9dad-11d1-80b4-00c04fd430c8",
         "00000000-0000-0000-0000-000000000000", "550E8400-E29B-41D4-A716-446655440000",
         "1-1-1-1-1", "+1-2-3-4-5", "0000000000000000000001-0-0-0-0", "7fffffffffffffff-0-0-0-0"]
INVALID = ["invalid-uuid", "550e8400-e29b-41d4-a716", "550e8400-e29b-41d4-a716-446655440000-extra",
           "550e8400e29b41d4a716446655440000", "", "not-a-uuid-at-all", " " + E, E + " ", E + "\n",
           "8000000000000000-0-0-0-0", "1-1-1--1", "g-1-1-1-1", None]


def test_uuid_rule(spark):
    df = spark.createDataFrame([(u,) for u in VALID + INVALID], "u string")
    got = {r.u: r.ok for r in df.select("u", is_valid_uuid("u").alias("ok")).collect()}
    for u in VALID:
        assert got[u] is True, u
    for u in INVALID:
        assert got[u] is False, u


def test_bounds_inclusive_nan_inf(spark):
    vals = [180.0, -180.0, 180.0000001, -180.0000001, math.nan, math.inf, -math.inf, 0.0, 1.7976931348623157e308]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.ok for r in df.select(in_range("x", -180.0, 180.0).alias("ok")).collect()]
    assert got == [True, True, False, False, False, False, False, True, False]


def _codes(spark, rows, strict=False):
    df = spark.createDataFrame(rows, "event_id string, entity_id string, body string, received_ms long")
    return [r.error_code for r in V.validate_updates(df, strict).orderBy("received_ms").collect()]


def test_controller_cases(spark):
    ok = '{"coordinates": [0.0, 50.0]}'
    rows = [(E, S, ok, 1), ("invalid-uuid", S, ok, 2), (E, "invalid-uuid", ok, 3),
            (E, S, '{"coordinates": [181.0, 50.0]}', 4), (E, S, '{"coordinates": [-181.0, 50.0]}', 5),
            (E, S, '{"coordinates": [0.0, 91.0]}', 6), (E, S, '{"coordinates": [0.0, -91.0]}', 7),
            (E, S, '{"location": [0.0, 50.0]}', 8), (E, S, '{"coordinates": [0.0]}', 9),
            (E, S, '{"coordinates": []}', 10), (E, S, '{"coordinates": [1.0, 2.0, 3.0]}', 11),
            (E, S, "not valid json", 12), (E, S, '{"coordinates": [invalid]}', 13),
            (E, S, '{"coordinates": ["NaN", 2]}', 14), (E, S, '{"coordinates": [1, null]}', 15),
            (E, S, '{"coordinates": [1, "2"]}', 16), (E, S, '{"coordinates": [1, true]}', 17),
            ("invalid-uuid", "invalid-uuid", "not json", 18), (E, S, '{"coordinates": [200.0, 100.0]}', 19),
            (E, S, '{"coordinates": [1e400, 2]}', 20)]
    assert _codes(spark, rows) == [
        None, "INVALID_SKATING_EVENT_ID", "INVALID_SKATER_ID", "INVALID_LONGITUDE", "INVALID_LONGITUDE",
        "INVALID_LATITUDE", "INVALID_LATITUDE", "MISSING_COORDINATES", "INVALID_COORDINATES_LENGTH",
        "INVALID_COORDINATES_LENGTH", "INVALID_COORDINATES_LENGTH", "MISSING_COORDINATES",
        "MISSING_COORDINATES", "MISSING_COORDINATES", "MISSING_COORDINATES", "MISSING_COORDINATES",
        "MISSING_COORDINATES", "INVALID_SKATING_EVENT_ID", "INVALID_LONGITUDE", "INVALID_LONGITUDE"]
    strict = _codes(spark, [(E, S, "not valid json", 1), (E, S, '{"location": 1}', 2)], strict=True)
    assert strict == ["INVALID_JSON", "MISSING_COORDINATES"]


def test_split_and_payload(spark):
    df = spark.createDataFrame([(E, S, '{"coordinates": [200.0, 50.0]}', 1),
                                (E, S, '{"coordinates": [1.5, 2.5]}', 2),
                                ("x", S, '{"coordinates": [1.5, 2.5]}', 3)],
                               "event_id string, entity_id string, body string, received_ms long")
    acc, rej = V.split_valid(V.validate_updates(df))
    a = acc.collect()
    assert [(r.longitude, r.latitude, r.ts_ms) for r in a] == [(1.5, 2.5, 2)]
    p = {r.received_ms: json.loads(r.payload) for r in V.error_payload(rej).collect()}
    assert p[1] == {"error": "INVALID_LONGITUDE", "message": "Longitude must be between -180.0 and 180.0",
                    "details": {"field": "coordinates[0]", "value": 200.0, "constraint": "range(-180.0, 180.0)"}}
    assert p[3] == {"error": "INVALID_SKATING_EVENT_ID", "message": "Skating event ID must be a valid UUID"}


def test_for_events_and_summary(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "event_id string, n int")
    assert sorted(r.event_id for r in V.for_events(df, " a , c,, ").collect()) == ["a", "c"]
    ids = spark.createDataFrame([("b",), ("b",)], "id string")
    assert [r.event_id for r in V.for_events(df, ids).collect()] == ["b"]
    t = V.for_events_text(df, F.lit("c, a"))
    assert sorted(r.event_id for r in t.collect()) == ["a", "c"]


def test_text_behind_the_body_is_rejected(spark):
    from pyspark.sql import functions as F

    from loctrack.operators import validate as V

    ok, c = '{"coordinates":[1.0,2.0]}', "550e8400-e29b-41d4-a716-446655440000"
    bodies = [ok + " junk", ok + "]", ok + "} {}", ok + "] {}", ok + "," + ok, ok + "],[{}", ok + "},{\"b\":1", ok + "  \n", ok, "", "not json"]
    df = spark.createDataFrame([(i, c, c, b, 0) for i, b in enumerate(bodies)], "seq long, event_id string, entity_id string, body string, received_ms long")
    got = {r.seq: r.n for r in df.select("seq", F.size(V.coordinates_from_body("body")).alias("n")).collect()}
    assert [i for i, n in got.items() if n == 2] == [7, 8]
    strict = {r.seq: r.error_code for r in V.validate_updates(df, strict_json=True).collect()}
    assert [i for i, e in sorted(strict.items()) if e is None] == [7, 8]
    assert {strict[i] for i in (0, 1, 2, 3, 4, 10)} == {"INVALID_JSON"}
