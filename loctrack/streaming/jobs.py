"""K1-K7: Structured Streaming forms of the keyed operators.

State lives in Spark's state store (checkpointed under the shared
``spark.checkpoint.dir``), so a lost executor or a restarted driver resumes
from the last committed micro-batch.  Sinks written from ``foreachBatch``
overwrite one folder per batch id, so a replayed batch replaces its own output
instead of duplicating it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loctrack.functions import floor_div
from loctrack.operators import validate as V
from loctrack.operators import windows as E
from loctrack.operators.grouping import next_open, opening_rows
from loctrack.session import checkpoint_dir


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """A fresh checkpoint folder for a new query under the shared checkpoint dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def with_event_time(df: DataFrame, ms: str = "ts_ms") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis(F.col(ms)))


# ----------------------------------------------------------------------------- K1
def ingest_stream(raw: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str,
                  strict_json: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """K1: validate raw requests continuously and route them to two sinks.

    Accepted rows are written partitioned by ``event_id`` (later reads of one
    event prune to its folder); rejected rows keep code and payload.  Each
    micro-batch is validated once (persisted), written to both sinks, released."""
    def route(batch: DataFrame, batch_id: int) -> None:
        v = V.validate_updates(batch, strict_json).persist()
        try:
            acc, rej = V.split_valid(v)
            # one event's rows to few tasks, a hot event's to more: AQE splits and merges them
            acc.hint("rebalance", "event_id").write.mode("overwrite").partitionBy("event_id").parquet(f"{accepted_path}/batch_id={batch_id}")
            V.error_payload(rej).drop("details").write.mode("overwrite") \
                .parquet(f"{rejected_path}/batch_id={batch_id}")
        finally:
            v.unpersist()

    w = raw.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# ----------------------------------------------------------------------------- K2
LATEST_OUT = ("event_id string, entity_id string, longitude double, latitude double, ts_ms long, "
              "seq long, change string")
LATEST_STATE = "entity_id array<string>, longitude array<double>, latitude array<double>, ts_ms array<long>, seq array<long>"
_HELD = ["entity_id", "longitude", "latitude", "ts_ms", "seq"]


def latest_state_stream(updates: DataFrame, ttl_ms: int, watermark_ms: int = 1000,
                        emit_removals: bool = False, spread: int = 16) -> DataFrame:
    """K2: keyed latest position with event-time expiry.

    Per (event, entity) the state holds the newest row (by ts, seq).  Rows behind
    the watermark are dropped.  The other rows of a key in a batch are reduced to
    the newest one, which is stored and emitted as an upsert if it is newer than
    the state.  A key is removed when the watermark has passed ts + ttl (whole
    seconds); ``emit_removals`` also emits a removal row (the service itself sends
    none).

    The entities of an event are held in ``spread`` groups by hash, so Python sees
    a few large groups, each merged as arrays, instead of single keys; a group is
    written anew when one of its entities changes, so it should hold some hundreds
    to thousands of them: ``spread`` grows with the entities of the largest event.
    A group times out with its oldest row.
    """
    ttl = (ttl_ms // 1000) * 1000
    src = with_event_time(updates).withWatermark("event_time", f"{watermark_ms} milliseconds") \
        .withColumn("_group", F.pmod(F.xxhash64("entity_id"), F.lit(spread)))

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        parts = []
        if state.exists:
            parts.append(pd.DataFrame(dict(zip(_HELD, state.get))).assign(old=True))
        if not state.hasTimedOut:
            parts += [p.loc[p["ts_ms"] >= now, _HELD].assign(old=False) for p in pdfs]
        # of equal rows the stored one is kept, and is no change
        rows = pd.concat(parts).sort_values(["ts_ms", "seq", "old"]).drop_duplicates("entity_id", keep="last") if parts else pd.DataFrame()
        if rows.empty:
            return
        gone = rows["ts_ms"] + ttl < now  # of this batch's rows none, unless it held late rows alone
        out = [rows[~rows["old"]].assign(change="upsert")]
        if emit_removals:
            out.append(rows[gone].assign(change="remove"))
        held = rows[~gone]
        if held.empty:
            state.remove()
        else:
            state.update(tuple(held[c].tolist() for c in _HELD))
            # a time-out must not lie behind the watermark
            state.setTimeoutTimestamp(max(int(held["ts_ms"].min()) + ttl, now + 1))
        found = pd.concat(out)
        if len(found):
            found.insert(0, "event_id", key[0])
            yield found[[c.split()[0] for c in LATEST_OUT.split(", ")]]

    return src.groupBy("event_id", "_group").applyInPandasWithState(
        step, LATEST_OUT, LATEST_STATE, "update", GroupStateTimeout.EventTimeTimeout)


# ----------------------------------------------------------------------------- K3
GROUP_OUT = "key string, group_no long, group_open_ms long, n_rows long, first_msg long, last_msg long"
GROUP_COLS = [c.split()[0] for c in GROUP_OUT.split(", ")]
GROUP_STATE = "group_no long, open_ms long, n_rows long, first_msg long, last_msg long"
# A key that is silent for this long after its last group starts again at group 0.
KEEP_NUMBERS_MS = 7 * 86_400_000


def group_within_stream(rows: DataFrame, key: str, size: int, interval_ms: int, ts: str = "ts_ms",
                        order: str = "msg_no", watermark_ms: int = 1000,
                        keep_ms: int = KEEP_NUMBERS_MS) -> DataFrame:
    """K3: live "group within (size, interval)" per key, the streaming twin of E2.

    The state holds the open group (number, open time, rows, first and last row
    id).  A group is emitted as soon as it holds ``size`` rows, when a row
    arrives ``interval`` or later after it opened, or when the watermark passes
    open + interval.  Empty groups are never emitted; rows behind the watermark
    are dropped.  The number of a key's last group is kept until ``keep_ms`` after
    the group's time is over, so numbers go on over a pause; then the state is
    freed, and a later group of the key has number 0."""
    src = rows.withColumn("event_time", F.timestamp_millis(F.col(ts))) \
        .withWatermark("event_time", f"{watermark_ms} milliseconds") \
        .withColumn("_key", F.col(key).cast("string"))

    def step(keyt, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        g_no, open_ms, n, first, last = state.get if state.exists else (-1, now, 0, 0, 0)
        out = []

        def close() -> None:
            out.append(([g_no], [open_ms], [n], [first], [last]))

        if state.hasTimedOut:
            if not n:
                state.remove()
                return
            close()
            n = 0
        else:
            batch = pd.concat(list(pdfs))
            batch = batch[batch[ts] >= now].sort_values([order])
            m, t = batch[order].to_numpy(np.int64), batch[ts].to_numpy(np.int64)
            if n and len(t):  # rows of the group that is open
                over = np.flatnonzero(t - open_ms >= interval_ms)
                own = min(size - n, int(over[0]) if len(over) else len(t), len(t))
                if own:
                    n, last = n + own, int(m[own - 1])
                if n >= size or own < len(t):
                    close()
                    n = 0
                m, t = m[own:], t[own:]
            if len(t):  # groups that open in this batch, found as in E2
                starts = np.flatnonzero(opening_rows(next_open(t, len(t), size, interval_ms), 0, size))
                opens, ends = t[starts], np.append(starts[1:], len(t))
                # after a long silence the numbers start again, whether the state is still there or not
                again = np.diff(opens, prepend=open_ms) > interval_ms + keep_ms
                again[0] |= g_no < 0
                k = np.arange(len(starts))
                begun = np.maximum.accumulate(np.where(again, k, -1))
                numbers = np.where(begun >= 0, k - begun, g_no + 1 + k)
                whole = len(starts) - (ends[-1] - starts[-1] < size)
                if whole:
                    out.append(tuple(x[:whole].tolist() for x in (numbers, opens, ends - starts, m[starts], m[ends - 1])))
                g_no, open_ms, first, last = int(numbers[-1]), int(opens[-1]), int(m[starts[-1]]), int(m[-1])
                n = 0 if whole == len(starts) else int(ends[-1] - starts[-1])
            if n and open_ms + interval_ms < now:
                close()
                n = 0
        if g_no < 0:  # late rows alone
            return
        state.update((g_no, open_ms, n, first, last))
        state.setTimeoutTimestamp(max(open_ms + interval_ms + (0 if n else keep_ms), now + 1))
        for rows_out in out:
            yield pd.DataFrame(dict(zip(GROUP_COLS, ([keyt[0]] * len(rows_out[0]), *rows_out))))

    return src.groupBy("_key").applyInPandasWithState(
        step, GROUP_OUT, GROUP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ----------------------------------------------------------------------------- K4
def fan_out_stream(updates: DataFrame, viewers: DataFrame) -> DataFrame:
    """K4: live fan-out: stream-static join with the viewer table."""
    from loctrack.operators.joins import fan_out
    return fan_out(updates, viewers)


def _seats_stream(viewers: DataFrame, bucket_ms: int, open_ms: int, late_ms: int) -> DataFrame:
    """A row for each bucket in which a viewer is subscribed; one without an end
    is seated for ``open_ms``."""
    end = F.coalesce("left_ms", F.col("subscribed_ms") + F.lit(open_ms))
    seats = F.when(end >= F.col("subscribed_ms"), F.sequence(floor_div("subscribed_ms", bucket_ms), floor_div(end, bucket_ms)))
    v = viewers.select("viewer_id", F.col("event_id").alias("_ev"), "subscribed_ms", end.alias("_end"), F.explode(seats).alias("_bucket"))
    return v.withColumn("bucket_time", F.timestamp_millis(F.col("_bucket") * F.lit(bucket_ms))) \
        .withWatermark("bucket_time", f"{late_ms + bucket_ms} milliseconds")


def fan_out_streams(updates: DataFrame, viewers: DataFrame, late_ms: int, bucket_ms: int = 3_600_000,
                    open_ms: int = 86_400_000) -> DataFrame:
    """K4 with viewers that come and go while the stream runs: an interval join of
    two streams, D1's pairs (``subscribed_ms < ts <= left_ms``).

    Viewers stand in a seat for each bucket of their time, so the join is an
    equality on event and bucket, and a hot event is one key for each bucket.
    Both sides have a watermark: rows may come ``late_ms`` (and a bucket) behind
    the newest row of the slower stream, so an update waits for viewers that are
    announced late, and a viewer's seat for late updates.  The bounds on times let
    Spark free a seat, and the updates of a bucket, once the watermark has passed
    the bucket's end; a viewer who has left holds no state.  A viewer without an
    end is seated for ``open_ms``, which bounds its state; announce it again to
    stay longer."""
    from loctrack.operators.joins import _UPD
    u = with_event_time(updates.select(*_UPD)).withWatermark("event_time", f"{late_ms + bucket_ms} milliseconds") \
        .withColumn("_at", floor_div("ts_ms", bucket_ms))
    v = _seats_stream(viewers, bucket_ms, open_ms, late_ms)
    in_bucket = (F.col("event_time") >= F.col("bucket_time")) & (F.col("event_time") < F.col("bucket_time") + F.expr(f"INTERVAL {bucket_ms} MILLISECOND"))
    live = (F.col("ts_ms") > F.col("subscribed_ms")) & (F.col("ts_ms") <= F.col("_end"))
    return u.join(v, (F.col("event_id") == F.col("_ev")) & (F.col("_at") == F.col("_bucket")) & in_bucket & live, "inner") \
        .select("viewer_id", *_UPD, "subscribed_ms")


# ----------------------------------------------------------------------------- K2 on the sweep grid
def lifetimes_stream(updates: DataFrame, ttl_ms: int, sweep_ms: int, origin_ms: int = 0, watermark_ms: int = 1000) -> DataFrame:
    """K2 with removals at sweep times: each stay of a participant in the store,
    emitted when the watermark passes the sweep that removes it.

    A row holds its participant until the first sweep at which it is older than
    the ttl, a time that the row alone decides.  So a stay is a session whose gap
    is the way to that sweep, its end is the sweep, and it goes on if the next
    update comes by then: a session window with a gap for each row, which Spark
    merges and times out in its own state store.  No timer is set, and rows that
    arrive out of order are merged in.  Emits (event_id, entity_id, entered_ms,
    removed_at_ms, n_updates and the last row)."""
    from loctrack.operators.joins import _UPD
    from loctrack.operators.state import removal_sweep
    src = with_event_time(updates.select(*_UPD)).withWatermark("event_time", f"{watermark_ms} milliseconds")
    hold = removal_sweep(F.col("ts_ms"), ttl_ms, sweep_ms, origin_ms) - F.col("ts_ms")
    gap = F.concat(hold.cast("string"), F.lit(" milliseconds"))
    last = F.max_by(F.struct("longitude", "latitude", "ts_ms", "seq"), F.struct("ts_ms", "seq"))
    s = src.groupBy("event_id", "entity_id", F.session_window("event_time", gap).alias("w")) \
        .agg(F.min("ts_ms").alias("entered_ms"), F.count(F.lit(1)).alias("n_updates"), last.alias("_v"))
    return s.select("event_id", "entity_id", "entered_ms", F.unix_millis("w.end").alias("removed_at_ms"), "n_updates", "_v.*")


# ----------------------------------------------------------------------------- K3 by windows
def batch_grid_stream(rows: DataFrame, key: str, size: int, interval_ms: int, ts: str = "ts_ms",
                      order: list[str] = ("msg_no",), watermark_ms: int = 1000, origin_ms: int = 0) -> DataFrame:
    """K3 in its cheap form, E1 live: tumbling windows of ``interval_ms`` per key,
    each cut in chunks of ``size`` by position, without Python or own state.

    The window's rows are kept as (order..., ts) only and sorted when the watermark
    closes the window; a key holds at most the rows of its open windows.  Emits a
    row for each chunk: (key, window_ms, batch_no, n_rows, first, last)."""
    src = rows.select(F.col(key).alias("_key"), *order, F.col(ts).alias("_t")).withColumn("event_time", F.timestamp_millis("_t")) \
        .withWatermark("event_time", f"{watermark_ms} milliseconds")
    start = f"{origin_ms % interval_ms} milliseconds"
    w = F.window("event_time", f"{interval_ms} milliseconds", f"{interval_ms} milliseconds", start)
    g = src.groupBy("_key", w.alias("w")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_rows"))
    n = F.size("_rows")
    chunk = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    each = g.select(F.col("_key").alias(key), F.unix_millis("w.start").alias("window_ms"), "_rows", chunk.alias("batch_no"))
    part = each.withColumn("_part", F.slice("_rows", F.col("batch_no") * size + 1, F.lit(size)))
    return part.select(key, "window_ms", F.col("batch_no").cast("long").alias("batch_no"), F.size("_part").cast("long").alias("n_rows"),
                       F.element_at("_part", 1).alias("first"), F.element_at("_part", -1).alias("last"))


# ----------------------------------------------------------------------------- K5
def channel_sessions_stream(accesses: DataFrame, ttl_ms: int, watermark_ms: int = 1000) -> DataFrame:
    """K5: channel sessions closed after ``ttl`` idle (session window, append
    mode: a session is emitted once the watermark passes its end)."""
    src = accesses.withColumn("event_time", F.timestamp_millis("access_ms")) \
        .withWatermark("event_time", f"{watermark_ms} milliseconds")
    s = src.groupBy("event_id", F.session_window("event_time", f"{ttl_ms} milliseconds").alias("w")) \
        .agg(F.min("access_ms").alias("started_ms"), F.max("access_ms").alias("last_access_ms"),
             F.count(F.lit(1)).alias("n_accesses"))
    return s.select("event_id", "started_ms", "last_access_ms", "n_accesses",
                    (F.col("last_access_ms") + F.lit(ttl_ms)).alias("removed_at_ms"))


# ----------------------------------------------------------------------------- K6
def newest_n_stream(rows: DataFrame, n: int, kept_path: str, dropped_path: str, checkpoint: str,
                    key: str = "event_id", trigger: dict | None = None) -> StreamingQuery:
    """K6: a buffer of the newest ``n`` rows per key that outlives the triggers.

    Each micro-batch adds its rows to the buffer that the batch before left
    under ``kept_path``, keeps the newest ``n`` per key, and records how many
    rows it pushed out.  ``kept_path/batch_id=<last>`` is the buffer now; only
    the newest two are needed."""
    def step(batch: DataFrame, batch_id: int) -> None:
        rows_now = batch
        if batch_id:
            before = batch.sparkSession.read.schema(batch.schema).parquet(f"{kept_path}/batch_id={batch_id - 1}")
            rows_now = batch.unionByName(before)
        rows_now = rows_now.persist()
        try:
            E.newest_n(rows_now, n, key).write.mode("overwrite").parquet(f"{kept_path}/batch_id={batch_id}")
            E.dropped_count(rows_now, n, key).withColumn("batch_id", F.lit(batch_id)) \
                .write.mode("overwrite").parquet(f"{dropped_path}/batch_id={batch_id}")
        finally:
            rows_now.unpersist()

    w = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# ----------------------------------------------------------------------------- K7
def publish_rate_stream(updates: DataFrame, window_ms: int = 60_000, watermark_ms: int = 1000) -> DataFrame:
    """K7: accepted updates per event and tumbling window, emitted when the
    watermark closes the window (append)."""
    src = with_event_time(updates).withWatermark("event_time", f"{watermark_ms} milliseconds")
    g = src.groupBy("event_id", F.window("event_time", f"{window_ms} milliseconds").alias("w")) \
        .agg(F.count(F.lit(1)).alias("n_updates"))
    return g.select("event_id", F.unix_millis(F.col("w.start")).alias("window_ms"), "n_updates")
