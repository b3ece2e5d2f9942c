"""Validation of raw location updates, error payloads, event filters.

The whole check is one projection (a CASE chain, first failure wins) that stays
inside whole-stage code generation; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loctrack import schemas as S
from loctrack.functions import in_range, is_valid_uuid, split_ids

COORDS_FIELD = "coordinates: array<double>"
_JSON_OPTS = {"allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def coordinates_from_body(body) -> Column:
    """B2: the ``coordinates`` array of a JSON body as array<double>, else null.

    Null when the body is not one JSON document (text behind it counts), has no
    ``coordinates`` field, or any element is not a number (a null element, a
    string, a boolean, NaN text).  Of a repeated field the last readable one counts.

    The parsers stop behind the first document, so the body is read inside an
    array and inside an object: no text behind it closes both.
    """
    body = F.col(body) if isinstance(body, str) else body
    one = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<struct<{COORDS_FIELD}>>", _JSON_OPTS)
    two = F.from_json(F.concat(F.lit('{"b":'), body, F.lit("}")), f"b struct<{COORDS_FIELD}>", _JSON_OPTS)["b"]
    # lambdas name what was read, so that each parser runs once for a body
    read = F.transform(F.array(F.struct(one.alias("one"), two.alias("two"))), lambda p: F.when(
        (F.size(p["one"]) == 1) & p["two"].isNotNull(), F.get(p["one"], F.lit(0))["coordinates"]))
    return F.get(F.filter(read, lambda arr: ~F.coalesce(F.exists(arr, lambda x: x.isNull()), F.lit(False))), F.lit(0))


def body_is_json(body) -> Column:
    """True when the body is one JSON document (used by the strict mode)."""
    body = F.col(body) if isinstance(body, str) else body
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    two = F.try_parse_json(F.concat(F.lit('{"b":'), body, F.lit("}")))
    return F.coalesce((F.size(one) == 1) & two.isNotNull(), F.lit(False))


def error_code(event_id: Column, entity_id: Column, coords: Column,
               json_ok: Column | None = None) -> Column:
    """B4 core: the first failing check, or null when the update is valid."""
    chain = F.when(~is_valid_uuid(event_id), F.lit("INVALID_SKATING_EVENT_ID")) \
        .when(~is_valid_uuid(entity_id), F.lit("INVALID_SKATER_ID"))
    if json_ok is not None:
        chain = chain.when(~json_ok, F.lit("INVALID_JSON"))
    return (chain.when(coords.isNull(), F.lit("MISSING_COORDINATES"))
            .when(F.size(coords) != 2, F.lit("INVALID_COORDINATES_LENGTH"))
            .when(~in_range(F.get(coords, 0), S.LON_MIN, S.LON_MAX), F.lit("INVALID_LONGITUDE"))
            .when(~in_range(F.get(coords, 1), S.LAT_MIN, S.LAT_MAX), F.lit("INVALID_LATITUDE")))


def validate_updates(df: DataFrame, strict_json: bool = False) -> DataFrame:
    """Add ``coordinates`` (decoded from ``body`` when absent) and ``error_code``.

    Input: ``event_id, entity_id`` and either ``coordinates array<double>`` or a
    JSON ``body``.  With ``strict_json`` an unparsable body is INVALID_JSON instead
    of MISSING_COORDINATES.
    """
    if "coordinates" in df.columns:
        coords = F.when(F.exists("coordinates", lambda x: x.isNull()), F.lit(None)) \
            .otherwise(F.col("coordinates"))
        json_ok = None
    else:
        coords = coordinates_from_body("body")
        json_ok = body_is_json("body") if strict_json else None
    out = df.withColumn("coordinates", coords)
    return out.withColumn("error_code", error_code(F.col("event_id"), F.col("entity_id"),
                                                   F.col("coordinates"), json_ok))


def _only(df: DataFrame, keep: Column, cols: list[str], made: dict[str, Column]) -> DataFrame:
    """The rows of ``df`` for which ``keep`` holds, with ``cols`` and the columns ``made``.

    A filter on a computed column is pushed below the projections that compute it,
    with their expressions copied in for each mention, so a body would be parsed
    many times.  Here the made columns leave a generator of one row or none: they
    are computed once, and a filter on ``cols`` still passes down to the scan."""
    one = F.array(F.struct(*(c.alias(n) for n, c in made.items())))
    return df.select(*cols, F.inline(F.when(keep, one)))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  Accepted rows become updates with longitude,
    latitude and ``ts_ms`` (arrival time); rejected rows keep their payload and
    get status 400.  Both read the same lazy plan, so a writer that needs both
    should write the validated frame once."""
    ts = "ts_ms" if "ts_ms" in validated.columns else "received_ms"
    seq = ["seq"] if "seq" in validated.columns else []
    code = F.col("error_code")
    point = {"longitude": F.get("coordinates", 0), "latitude": F.get("coordinates", 1)}
    accepted = _only(validated, code.isNull(), ["event_id", "entity_id", ts, *seq], point).select(
        "event_id", "entity_id", "longitude", "latitude", F.col(ts).alias("ts_ms"), *seq)
    rest = [c for c in validated.columns if c != "error_code"]
    rejected = _only(validated, code.isNotNull(), rest, {"error_code": code, "status": F.lit(400)}) \
        .select(*validated.columns, "status")
    return accepted, rejected


def _lookup(mapping: dict, key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.element_at(m, key)


def error_payload(rejected: DataFrame) -> DataFrame:
    """Error, message and (for coordinate bounds) details field/value/constraint,
    plus the JSON text of the response body (``details`` omitted when absent).

    The code table is a constant map folded into the projection: no join at all."""
    code = F.col("error_code")
    value = F.when(code == "INVALID_LONGITUDE", F.get("coordinates", 0)) \
        .when(code == "INVALID_LATITUDE", F.get("coordinates", 1))
    details = F.when(value.isNotNull() | code.isin("INVALID_LONGITUDE", "INVALID_LATITUDE"),
                     F.struct(_lookup(S.ERROR_FIELD, code).alias("field"), value.alias("value"),
                              _lookup(S.ERROR_CONSTRAINT, code).alias("constraint")))
    out = rejected.withColumn("error", code) \
        .withColumn("message", _lookup(S.ERROR_MESSAGE, code)) \
        .withColumn("details", details)
    return out.withColumn("payload", F.to_json(F.struct("error", "message", "details")))


def for_events(df: DataFrame, ids, col: str = "event_id") -> DataFrame:
    """Keep rows of the given events.

    ``ids`` is a list, a comma-separated text (split, trimmed, blanks dropped),
    or a one-column DataFrame of ids (left semi join; Spark broadcasts it when
    its measured size is under the broadcast threshold, else shuffles)."""
    if isinstance(ids, DataFrame):
        other = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
        return df.join(other, df[col] == other["_id"], "left_semi")
    if isinstance(ids, str):
        ids = [s.strip() for s in ids.split(",") if s.strip()]
    return df.filter(F.col(col).isin(list(ids)))


def for_events_text(df: DataFrame, ids_text: Column, col: str = "event_id") -> DataFrame:
    """B7 with the id list as a column (e.g. a per-row parameter)."""
    return df.filter(F.array_contains(split_ids(ids_text, ","), F.col(col)))


def rejection_summary(validated: DataFrame, by_event: bool = False) -> DataFrame:
    """Rejected count per error code (and event).  Partial aggregation."""
    keys = ["error_code"] + (["event_id"] if by_event else [])
    code = F.col("error_code")
    return _only(validated, code.isNotNull(), keys[1:], {"error_code": code}).groupBy(*keys) \
        .agg(F.count(F.lit(1)).alias("n"))
