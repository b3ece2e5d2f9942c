"""Latest position per key, retention, sweeps, presence and channel sessions.

The reference keeps a map event -> entity -> latest location, removes entries
older than a ttl on a fixed sweep timer, and keeps one channel per event that is
removed after an idle ttl.  Here the same results come from closed forms over
the update history, so no timer is simulated:

* sweeps run at ``origin + k * every`` for k >= 1;
* a location with time ts is removed at the first sweep s with ts <= s - ttl
  (``ttl`` truncated to whole seconds), unless a newer update of the same key
  arrived by s;
* a channel with last access a is removed at the first sweep s with
  a < s - ttl; a later access opens a new session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loctrack.functions import ceil_div, floor_div, grid_floor
from loctrack.operators.sequence import Running, running_flag_count, sequence_features, split_hot_chunks
from loctrack.session import cut

KEY = ["event_id", "entity_id"]
ORDER = ["ts_ms", "seq"]
_VALUE_COLS = ["longitude", "latitude", "ts_ms", "seq"]


def _order(df: DataFrame, order_by: str) -> list[str]:
    if order_by == "arrival" and "seq" in df.columns:
        return ["seq"]
    return [c for c in ORDER if c in df.columns]


def latest_locations(updates: DataFrame, order_by: str = "event_time",
                     keys: list[str] = KEY) -> DataFrame:
    """The last write per (event, entity).

    ``max_by`` keeps partial (map-side) aggregation, so even one hot key is
    combined before the shuffle; no sort of the key's history is needed."""
    order = _order(updates, order_by)
    vals = [c for c in updates.columns if c not in keys]
    best = F.max_by(F.struct(*vals), F.struct(*order)).alias("_v")
    return updates.groupBy(*keys).agg(best).select(*keys, *[F.col("_v")[c].alias(c) for c in vals])


def upsert(snapshot: DataFrame, updates: DataFrame, order_by: str = "event_time") -> DataFrame:
    """Apply a batch of updates to a snapshot (last write wins)."""
    return latest_locations(snapshot.unionByName(updates, allowMissingColumns=True), order_by)


def location_cutoff(now_ms: int, ttl_ms: int) -> int:
    """Rows with ts > cutoff are kept; the ttl is truncated to whole seconds."""
    return now_ms - (ttl_ms // 1000) * 1000


def retain_live(snapshot: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Keep ``ts > now - ttl`` (equality is dropped)."""
    return snapshot.filter(F.col("ts_ms") > F.lit(location_cutoff(now_ms, ttl_ms)))


def sweep(snapshot: DataFrame, now_ms: int, ttl_ms: int) -> tuple[DataFrame, DataFrame]:
    """C4: (kept rows, per-event summary of one sweep at ``now``).

    Summary: rows before, removed, kept, and whether the event was left empty
    (it then disappears from the store).  One aggregation with ``count_if``."""
    live = F.col("ts_ms") > F.lit(location_cutoff(now_ms, ttl_ms))
    kept = snapshot.filter(live)
    summary = snapshot.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(~live).alias("n_removed"),
        F.count_if(live).alias("n_kept"),
    ).withColumn("emptied", F.col("n_kept") == 0)
    return kept, summary


def last_sweep_ms(at_ms: int, origin_ms: int, every_ms: int) -> int | None:
    """Time of the last sweep at or before ``at`` (None before the first one)."""
    k = (at_ms - origin_ms) // every_ms
    return origin_ms + k * every_ms if k >= 1 else None


def snapshot_as_of(updates: DataFrame, at_ms: int, ttl_ms: int, sweep_ms: int,
                   origin_ms: int = 0, read_ttl: bool = False) -> DataFrame:
    """What a reader of the store sees at ``at``.

    Reads do not apply the ttl: an expired row stays visible until the next
    sweep removes it.  Visible iff it is the latest update with ts <= at and
    (no sweep has run yet, or ts > last_sweep - ttl).  ``read_ttl=True`` gives
    the strict view (ts > at - ttl)."""
    latest = latest_locations(updates.filter(F.col("ts_ms") <= F.lit(at_ms)))
    if read_ttl:
        return retain_live(latest, at_ms, ttl_ms)
    last = last_sweep_ms(at_ms, origin_ms, sweep_ms)
    if last is None:
        return latest
    return retain_live(latest, last, ttl_ms)


def removal_sweep(ts, ttl_ms: int, sweep_ms: int, origin_ms: int):
    """First sweep s >= origin + every with ts <= s - ttl (whole-second ttl)."""
    ttl = (ttl_ms // 1000) * 1000
    k = ceil_div(ts + F.lit(ttl) - F.lit(origin_ms), sweep_ms)
    return F.lit(origin_ms) + F.greatest(k, F.lit(1)) * F.lit(sweep_ms)


def versions(updates: DataFrame, ttl_ms: int, sweep_ms: int, origin_ms: int,
              chunk_ms: int) -> DataFrame:
    """Every update with the next update of its key and its own end:
    ``removed_at`` (a sweep) or replaced at ``next_ts_ms``."""
    nb = sequence_features(updates, KEY, ORDER, floor_div("ts_ms", chunk_ms), next=["ts_ms"])
    s = removal_sweep(F.col("ts_ms"), ttl_ms, sweep_ms, origin_ms)
    removed = F.col("next_ts_ms").isNull() | (F.col("next_ts_ms") > s)
    return nb.withColumn("removed_at_ms", F.when(removed, s)) \
             .withColumn("end_ms", F.coalesce(F.col("removed_at_ms"), F.col("next_ts_ms")))


def lifetime_points(updates: DataFrame, ttl_ms: int, sweep_ms: int, origin_ms: int = 0,
                    chunk_ms: int = 86_400_000) -> DataFrame:
    """(event_id, entity_id, t_ms, delta): +1 where a participant enters the
    store, -1 at the sweep that removes it.  Replacements give no point, so there
    are far fewer points than updates."""
    nb = sequence_features(updates.select(*KEY, *ORDER), KEY, ORDER, floor_div("ts_ms", chunk_ms),
                           prev=["ts_ms"], next=["ts_ms"])
    at = F.col("ts_ms")
    removed, removed_before = (removal_sweep(c, ttl_ms, sweep_ms, origin_ms) for c in (at, F.col("prev_ts_ms")))
    point = lambda t, d: F.struct(t.alias("t_ms"), F.lit(d).cast("long").alias("delta"))
    both = F.array(F.when(F.col("prev_ts_ms").isNull() | (at > removed_before), point(at, 1)),
                   F.when(F.col("next_ts_ms").isNull() | (F.col("next_ts_ms") > removed), point(removed, -1)))
    return nb.select(*KEY, F.explode(F.filter(both, lambda p: p.isNotNull())).alias("_p")).select(*KEY, "_p.*")


def presence_points(points: DataFrame, chunk_ms: int = 86_400_000) -> DataFrame:
    """(event_id, t_ms, delta): +1 where an event appears in the store and -1
    where its last participant is removed.  Of points at one time the entries
    come first, so intervals that touch are one."""
    p = points.withColumn("_o", -F.col("delta"))
    open_ = sequence_features(p, ["event_id"], ["t_ms", "_o", "entity_id"], floor_div("t_ms", chunk_ms),
                              running={"_open": Running(F.col("delta"), "sum")})
    edge = ((F.col("delta") == 1) & (F.col("_open") == 1)) | ((F.col("delta") == -1) & (F.col("_open") == 0))
    return open_.filter(edge).select("event_id", "t_ms", "delta")


def removal_log(updates: DataFrame, ttl_ms: int, sweep_ms: int, origin_ms: int = 0,
                by_event: bool = False, chunk_ms: int = 86_400_000) -> DataFrame:
    """Rows removed per sweep time (sweeps that remove nothing are not listed)."""
    v = versions(updates, ttl_ms, sweep_ms, origin_ms, chunk_ms)
    keys = ["removed_at_ms"] + (["event_id"] if by_event else [])
    return v.filter(F.col("removed_at_ms").isNotNull()).groupBy(*keys) \
        .agg(F.count(F.lit(1)).alias("n_removed")).withColumnRenamed("removed_at_ms", "sweep_ms")


def _islands(rows: DataFrame, key: str, start: str, end: str, order: list[str],
             chunk_ms: int) -> DataFrame:
    """Gaps and islands over [start, end) intervals of one key, in two chunked
    passes: exclusive running max of ``end``, then a running count of island
    starts.  Adds ``island_no`` (1-based).  Both passes share one chunking
    (hot cells are found once)."""
    r = split_hot_chunks(rows, [key], order, floor_div(start, chunk_ms)).withColumnRenamed("_chunk", "_ck")
    a = sequence_features(r, [key], order, F.col("_ck"), max_chunk_rows=None,
                          running={"_prev_end": Running(F.col(end), "max", inclusive=False)})
    new = (F.col("_prev_end").isNull() | (F.col(start) > F.col("_prev_end"))).cast("long")
    b = sequence_features(a.withColumn("_new", new), [key], order, F.col("_ck"), max_chunk_rows=None,
                          running={"island_no": Running(F.col("_new"), "sum", inclusive=True)})
    return b.drop("_prev_end", "_new", "_ck")


def event_presence(updates: DataFrame, ttl_ms: int, sweep_ms: int, origin_ms: int = 0,
                   chunk_ms: int = 86_400_000) -> DataFrame:
    """Intervals in which an event exists in the store.

    An event appears with its first write and disappears at the sweep that
    leaves it empty.  Each update lives from its ts to its replacement or its
    removal; an event's presence is the union of these intervals."""
    v = cut(versions(updates, ttl_ms, sweep_ms, origin_ms, chunk_ms), "versions")
    isl = _islands(v, "event_id", "ts_ms", "end_ms", ["ts_ms", "entity_id", "seq"], chunk_ms)
    return isl.groupBy("event_id", "island_no").agg(
        F.min("ts_ms").alias("present_from_ms"),
        F.max("end_ms").alias("removed_at_ms"),
        F.count(F.lit(1)).alias("n_updates"),
        F.count_distinct("entity_id").alias("n_entities"),
    )


def channel_removal(access, ttl_ms: int, sweep_ms: int | None, origin_ms: int = 0):
    """When a channel last accessed at ``access`` is removed: the first sweep s
    with access < s - ttl; without a sweep grid, exactly ttl after."""
    if sweep_ms is None:
        return access + F.lit(ttl_ms)
    return F.lit(origin_ms) + (floor_div(access + F.lit(ttl_ms) - F.lit(origin_ms), sweep_ms)
                               + F.lit(1)) * F.lit(sweep_ms)


def channel_sessions(accesses: DataFrame, ttl_ms: int, sweep_ms: int | None = None,
                     origin_ms: int = 0, chunk_ms: int = 86_400_000) -> DataFrame:
    """Per event, sessions of its fan-out channel.

    An access (publish or subscribe) creates the channel or refreshes it; the
    channel is removed at ``channel_removal(last access)``; an access after that
    opens a new session.  With ``sweep_ms=None`` this equals a session window
    with gap ``ttl`` (a gap exactly equal to the ttl stays one session)."""
    def new_session(prev, cur):
        return prev.isNull() | (cur["access_ms"] > channel_removal(prev["access_ms"], ttl_ms, sweep_ms, origin_ms))

    b = running_flag_count(accesses, ["event_id"], ["access_ms"], floor_div("access_ms", chunk_ms),
                           ["access_ms"], new_session, "session_no")
    s = b.groupBy("event_id", "session_no").agg(
        F.min("access_ms").alias("started_ms"),
        F.max("access_ms").alias("last_access_ms"),
        F.count(F.lit(1)).alias("n_accesses"),
    )
    return s.withColumn("removed_at_ms",
                        channel_removal(F.col("last_access_ms"), ttl_ms, sweep_ms, origin_ms))


def idle_channels(accesses: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Channels a sweep at ``now`` removes: last access < now - ttl
    (equality is kept).  Only accesses up to ``now`` count."""
    last = accesses.filter(F.col("access_ms") <= F.lit(now_ms)).groupBy("event_id") \
        .agg(F.max("access_ms").alias("last_access_ms"))
    return last.filter(F.col("last_access_ms") < F.lit(now_ms - ttl_ms)) \
        .withColumn("idle_ms", F.lit(now_ms) - F.col("last_access_ms"))
