"""Batching, envelopes, drop-head buffers, the viewer's table, message
numbering and silence detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from loctrack.functions import clock12_text, fixed6_text, floor_div, grid_floor
from loctrack.operators import grouping as G
from loctrack.operators import state as C
from loctrack.operators.sequence import Running, sequence_features
from loctrack.schemas import LOCATION


def batch_grid(rows: DataFrame, key: str, ts: str, size: int, interval_ms: int,
               origin_ms: int = 0, order: list[str] = ("ts_ms", "seq"), sub_chunks: int = 16,
               position: str | None = None) -> DataFrame:
    """Replayable form of "group within (size, interval)": tumbling windows
    of ``interval`` per key, each cut into chunks of at most ``size`` rows.
    Adds ``window_ms`` (window start) and ``batch_no`` (0-based within it).

    The position in the window is a running count over (key, window) cut into
    ``sub_chunks`` time slices, so even one key's rows inside one window are
    sorted by several tasks (see ``sequence_features``).  When ``position``
    names a consecutive 1-based position of the rows of a key in
    ``(ts, *order)``, the position in the window is ``position`` minus the
    window's smallest one: a grouped minimum (partial aggregation) joined back,
    no sort at all."""
    r = rows.withColumn("window_ms", grid_floor(F.col(ts), origin_ms, interval_ms))
    if position is not None:
        first = r.groupBy(key, "window_ms").agg(F.min(position).alias("_p0")) \
            .select(F.col(key).alias("_fk"), F.col("window_ms").alias("_fw"), "_p0")
        j = r.join(first, (F.col(key).eqNullSafe(F.col("_fk"))) & (F.col("window_ms") == F.col("_fw")))
        return j.withColumn("batch_no", floor_div(F.col(position) - F.col("_p0"), size)) \
            .drop("_fk", "_fw", "_p0")
    sub = max(interval_ms // max(sub_chunks, 1), 1)
    n = sequence_features(r, [key, "window_ms"], [ts, *order], floor_div(F.col(ts) - F.lit(origin_ms), sub),
                          running={"_pos": Running(F.lit(1), "sum")})
    return n.withColumn("batch_no", floor_div(F.col("_pos") - F.lit(1), size)).drop("_pos")


def to_batches(grouped: DataFrame, key, interval_ms: int,
               order: list[str] = ("ts_ms", "seq")) -> DataFrame:
    """One envelope per batch: ``locations`` (rows in order, as the wire
    struct skaterId/latitude/longitude/timestamp) and ``serverTime`` (the window
    end).  Each group holds at most ``size`` rows."""
    loc = F.struct(F.col("entity_id").alias("skaterId"), F.col("latitude"), F.col("longitude"),
                   F.col("ts_ms").alias("timestamp"))
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], loc.alias("loc"))
    keys = [key] if isinstance(key, str) else list(key)
    g = grouped.groupBy(*keys, "window_ms", "batch_no").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return g.select(*keys, "window_ms", "batch_no",
                    F.transform("_items", lambda x: x["loc"]).cast(T.ArrayType(LOCATION)).alias("locations"),
                    (F.col("window_ms") + F.lit(interval_ms)).alias("serverTime"))


def group_within(rows: DataFrame, key, size: int, interval_ms: int, ts: str = "ts_ms",
                 order=("ts_ms", "seq"), chunk_rows: int = 65_536,
                 time_chunk_ms: int = 86_400_000, position: str | None = None) -> DataFrame:
    """Exact "either limit" grouping.  A group opens at its first row and
    closes when it holds ``size`` rows or when a row arrives ``interval`` or
    more after the group opened (that row opens the next group).  Distributed
    by row chunks with composed chunk functions (see ``grouping``): no task
    ever holds all rows of a key."""
    return G.group_within(rows, key, size, interval_ms, ts, order, chunk_rows, time_chunk_ms, position)


def newest_n(rows: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """Drop-head buffer: keep the newest ``n`` rows per key.  The rank
    filter lets Spark apply a window group limit before the shuffle, so each
    task forwards at most n rows per key."""
    w = Window.partitionBy(key).orderBy(F.col("ts_ms").desc(), F.col("seq").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def dropped_count(rows: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """Rows dropped per key by a buffer of ``n`` (partial count, no sort)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("n_dropped", F.greatest(F.col("n_rows") - F.lit(n), F.lit(0)))


def viewer_table(stream: DataFrame) -> DataFrame:
    """E5: per viewer the latest row per entity, coordinates with six decimals
    and the time as 12-hour clock text (UTC); never expires rows."""
    latest = C.latest_locations(
        stream.select("viewer_id", "event_id", "entity_id", "longitude", "latitude", "ts_ms", "seq"),
        keys=["viewer_id", "entity_id"])
    return latest.select("viewer_id", "entity_id",
                         fixed6_text("latitude").alias("latitude_text"),
                         fixed6_text("longitude").alias("longitude_text"),
                         clock12_text("ts_ms").alias("time_text"), "ts_ms")


def viewer_stats(stream: DataFrame) -> DataFrame:
    """Entities shown and time of the last update per viewer."""
    return stream.groupBy("viewer_id").agg(F.count_distinct("entity_id").alias("n_entities"),
                                           F.max("ts_ms").alias("last_update_ms"),
                                           F.count(F.lit(1)).alias("n_rows"))


def number_messages(deliveries: DataFrame, keys=("event_id", "viewer_number"),
                    ts: str = "receive_ms", order=("receive_ms", "seq"),
                    chunk_ms: int = 86_400_000) -> DataFrame:
    """Running message count per viewer; error rows repeat the count."""
    ok = (F.coalesce(F.col("error"), F.lit("")) == "").cast("long")
    return sequence_features(deliveries, list(keys), list(order), floor_div(ts, chunk_ms),
                             running={"message_count": Running(ok, "sum")})


def resume_check(deliveries: DataFrame, idle_ms: int, keys=("event_id", "viewer_number"),
                 ts: str = "receive_ms", order=("receive_ms", "seq"),
                 chunk_ms: int = 86_400_000) -> DataFrame:
    """Silences longer than ``idle`` after which the same viewer received
    messages again (the connection survived the idle time)."""
    ok = deliveries.filter(F.coalesce(F.col("error"), F.lit("")) == "")
    nb = sequence_features(ok, list(keys), list(order), floor_div(ts, chunk_ms), prev=[ts])
    gap = F.col(ts) - F.col(f"prev_{ts}")
    return nb.filter(gap > F.lit(idle_ms)).select(
        *keys, F.col(f"prev_{ts}").alias("silent_from_ms"), F.col(ts).alias("resumed_ms"),
        gap.alias("silence_ms"))
