"""A1-A5: raw requests, strict JSON decoding of updates and locations, batch
envelopes to and from JSON text.

Strict decoding uses Spark's VARIANT functions: ``try_parse_json`` and
``schema_of_variant`` tell a JSON string from a number, a null from an absent
field, and an integral number from a fractional one -- which ``from_json``
(that coerces numbers to text and drops fractions) cannot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loctrack.schemas import BATCH, RAW_UPDATES

_INTEGRAL = ["TINYINT", "SMALLINT", "INT", "BIGINT"]


def read_raw_updates(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A1: raw requests ``seq, event_id, entity_id, body, received_ms`` from
    JSON lines or parquet, as a batch or a streaming DataFrame (a message bus
    source has the same shape)."""
    if stream:
        r = spark.readStream.schema(RAW_UPDATES).format(fmt)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.load(path)
    return spark.read.schema(RAW_UPDATES).format(fmt).load(path)


def _vtype(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, f"$.{field}", "variant"))


def _is_number(t: Column) -> Column:
    return t.isin(*_INTEGRAL, "DOUBLE", "FLOAT") | t.startswith("DECIMAL")


def _str_field(v: Column, f: str):
    ok = F.coalesce(_vtype(v, f) == "STRING", F.lit(False))
    return ok, F.try_variant_get(v, f"$.{f}", "string")


def _num_field(v: Column, f: str):
    ok = F.coalesce(_is_number(_vtype(v, f)), F.lit(False))
    return ok, F.try_variant_get(v, f"$.{f}", "double")


def _long_field(v: Column, f: str, optional: bool):
    t = _vtype(v, f)
    d = F.try_variant_get(v, f"$.{f}", "double")
    n = F.try_variant_get(v, f"$.{f}", "bigint")
    integral = _is_number(t) & n.isNotNull() & (d == n.cast("double"))
    absent = t.isNull() | (t == "VOID")
    return (F.coalesce(integral, F.lit(False)) | absent) if optional else F.coalesce(integral, F.lit(False)), n


def _decode(col: Column, fields: list[tuple[str, str]], now_ms: Column | None) -> list[Column]:
    """Decode in field order; ``decode_error`` names the first failing field."""
    v = F.try_parse_json(col)
    err = F.when(v.isNull(), F.lit("invalid json"))
    out = []
    for name, kind in fields:
        if kind == "string":
            ok, val = _str_field(v, name)
        elif kind == "double":
            ok, val = _num_field(v, name)
        else:
            ok, val = _long_field(v, name, optional=now_ms is not None)
            if now_ms is not None:
                val = F.coalesce(val, now_ms)
        err = err.when(~ok, F.lit(f"invalid {name}"))
        out.append(F.when(ok, val).alias(name))  # a field of another type is not converted
    return [*out, err.alias("decode_error")]


def parse_flat_updates(df: DataFrame, col: str, now_ms=None) -> DataFrame:
    """A2: ``{eventId, skaterId, longitude, latitude, timestamp?}``.

    Ids must be JSON strings, coordinates JSON numbers; an absent or null
    timestamp becomes ``now_ms`` (a column or number; default the current time),
    a present one must be an integral number within 64 bits.  A field that
    fails is null, and ``decode_error`` names the first one."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else (now_ms if now_ms is not None
                                                          else F.unix_millis(F.current_timestamp()))
    fields = [("eventId", "string"), ("skaterId", "string"), ("longitude", "double"),
              ("latitude", "double"), ("timestamp", "long")]
    return df.select("*", *_decode(F.col(col), fields, now))


def parse_locations(df: DataFrame, col: str) -> DataFrame:
    """A3: ``{skaterId, latitude, longitude, timestamp}``, all required."""
    fields = [("skaterId", "string"), ("latitude", "double"), ("longitude", "double"), ("timestamp", "long")]
    return df.select("*", *_decode(F.col(col), fields, None))


def batches_to_json(df: DataFrame) -> Column:
    """A5: the envelope as JSON text with the wire field order
    ``{"locations":[{"skaterId","latitude","longitude","timestamp"}],"serverTime"}``."""
    return F.to_json(F.struct(F.col("locations").cast(BATCH["locations"].dataType).alias("locations"),
                              F.col("serverTime").cast("long").alias("serverTime")))


def write_batches(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: one JSON text line per batch (plus the key columns as partition-free text)."""
    df.select(batches_to_json(df).alias("value")).write.mode(mode).text(path)


def _typed(v: Column, field: str, kind: str) -> tuple[Column, Column]:
    """(is fine, value): absent and null are fine, another type is not."""
    t = _vtype(v, field)
    absent = t.isNull() | (t == "VOID")
    if kind == "string":
        right, value = t == "STRING", F.try_variant_get(v, f"$.{field}", "string")
    elif kind == "double":
        right, value = _is_number(t), F.try_variant_get(v, f"$.{field}", "double")
    else:
        value = F.try_variant_get(v, f"$.{field}", "bigint")
        right = _is_number(t) & value.isNotNull() & (F.try_variant_get(v, f"$.{field}", "double") == value.cast("double"))
    return absent | F.coalesce(right, F.lit(False)), value


def explode_batches(df: DataFrame, col: str, keep: list[str] = ()) -> DataFrame:
    """A4: one row per received location with its position in the batch; a
    message that does not decode gives one error row and the rest goes on.

    The message must be a JSON object, ``locations`` an array of objects, and
    every field of its type (text, number, integral number); null and absent
    fields are allowed and give null.  One pass: the message is parsed once and
    good and bad ones leave the same generator."""
    fields = [("skaterId", "string"), ("latitude", "double"), ("longitude", "double"), ("timestamp", "long")]

    def element(e: Column) -> Column:
        shape = F.schema_of_variant(e)
        checks = [_typed(e, n, k) for n, k in fields]
        fine = shape.startswith("OBJECT")
        for ok, _ in checks:
            fine = fine & ok
        return F.struct((fine | (shape == "VOID")).alias("ok"), *[v.alias(n) for (n, _), (_, v) in zip(fields, checks)])

    base = df.select(*keep, F.try_parse_json(F.col(col)).alias("_v"))
    time_ok, time = _typed(F.col("_v"), "serverTime", "long")
    listed = _vtype(F.col("_v"), "locations")
    base = base.select(*keep, F.schema_of_variant("_v").alias("_shape"), time_ok.alias("_time_ok"), time.alias("_time"),
                       (listed.isNull() | (listed == "VOID") | listed.startswith("ARRAY")).alias("_list_ok"),
                       F.transform(F.try_variant_get(F.col("_v"), "$.locations", "array<variant>"), element).alias("_items"))
    ok = F.coalesce(F.col("_shape").startswith("OBJECT") & F.col("_time_ok") & F.col("_list_ok")
                    & ~F.coalesce(F.exists("_items", lambda e: ~e["ok"]), F.lit(False)), F.lit(False))
    base = base.select(*keep, ok.alias("_ok"), "_time", "_items")
    rows = base.select(*keep, F.when(F.col("_ok"), F.col("_time")).alias("serverTime"), "_ok",
                       F.posexplode_outer(F.when(F.col("_ok"), F.col("_items"))).alias("pos", "_loc"))
    return rows.select(*keep, "serverTime", "pos", *[F.col("_loc")[n].alias(n) for n, _ in fields],
                       F.when(~F.col("_ok"), F.lit("failed to parse message")).alias("decode_error"))
