"""Fan-out to viewers, as-of snapshots per viewer, viewer streams,
stale rows in a viewer's table, isolation between events.

Every join is an equality on the event and a time bucket, with the exact times as
post-filter, so an update meets only the viewers of its own bucket and an event's
rows spread over as many keys as it has buckets.  No side is hinted: Spark
broadcasts the viewers only when their measured bytes are under its threshold;
otherwise both sides shuffle on (event, bucket) and AQE splits a hot one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loctrack.functions import floor_div, split_ids
from loctrack.operators import state as C
from loctrack.operators.sequence import Running, sequence_features
from loctrack.session import cut

_UPD = ["event_id", "entity_id", "longitude", "latitude", "ts_ms", "seq"]
# Width of the time buckets in the join keys.
BUCKET_MS = 3_600_000
# Updates, and pairs of update and viewer, of an (event, bucket) cell that one task joins.
CELL_ROWS, CELL_PAIRS = 1_000_000, 50_000_000


def _viewers(viewers: DataFrame) -> DataFrame:
    return viewers.select("viewer_id", F.col("event_id").alias("_ev"), "subscribed_ms", "left_ms")


def _cells(updates: DataFrame, bucket_ms: int) -> DataFrame:
    """(event, bucket, n) of the updates: one partial aggregation."""
    return updates.groupBy(F.col("event_id").alias("_cell_ev"), floor_div("ts_ms", bucket_ms).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))


def _seats(cells: DataFrame, viewers: DataFrame, bucket_ms: int) -> DataFrame:
    """The viewers once for each bucket in which they are subscribed and their
    event has updates; an open end costs no more than the event's buckets."""
    b = F.col("_bucket")
    return _viewers(viewers).join(cells, (F.col("_ev") == F.col("_cell_ev")) & (b >= floor_div("subscribed_ms", bucket_ms))
                                  & (F.col("left_ms").isNull() | (b <= floor_div("left_ms", bucket_ms)))).drop("_cell_ev", "_n")


def hot_cells(cells: DataFrame, viewers: DataFrame, cell_rows: int = CELL_ROWS, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(event, bucket, salts) of the cells that one task should not join: more
    than ``cell_rows`` updates, or more than ``cell_pairs`` pairs with the event's
    viewers.  Salts come from the measured numbers, so that a salted block holds
    no more than either bound (but one update at least); there are at most
    updates / ``cell_rows`` + pairs / ``cell_pairs`` such cells."""
    per = viewers.groupBy(F.col("event_id").alias("_ev")).agg(F.count(F.lit(1)).alias("_v"))
    rows = cells.join(per, F.col("_cell_ev") == F.col("_ev")).select(F.col("_cell_ev").alias("_hot_ev"), F.col("_bucket").alias("_hot_bucket"), "_n",
                                                                    F.greatest(F.col("_n") / cell_rows, F.col("_n") * F.col("_v") / cell_pairs).alias("_share"))
    return rows.filter("_share > 1").select("_hot_ev", "_hot_bucket", F.least(F.ceil("_share"), F.col("_n")).cast("int").alias("_salts"))


def _salted(df: DataFrame, hot: DataFrame, event: str, bucket: str, spread: list[str] | None) -> DataFrame:
    """``df`` with ``_salt``: one of the cell's salts by a hash of ``spread``, or
    each of them."""
    j = df.join(hot, (F.col(event) == F.col("_hot_ev")) & (F.col(bucket) == F.col("_hot_bucket")), "left")
    salts = F.coalesce("_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*spread), salts).cast("int") if spread else F.explode(F.sequence(F.lit(0), salts - 1))
    return j.withColumn("_salt", salt).drop("_hot_ev", "_hot_bucket", "_salts")


def fan_out(updates: DataFrame, viewers: DataFrame, bucket_ms: int = BUCKET_MS, cell_rows: int = CELL_ROWS, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Every update to every viewer of its event subscribed at that time
    (``subscribed_ms < ts <= left_ms``, open end when ``left_ms`` is null).

    The updates of each event and bucket are counted once (a small table); a hot
    cell's updates are dealt over salted blocks and its viewers stand in each of
    them, so one event with most updates and viewers is many even tasks.

    On a stream the buckets of later updates are not known, and the join is on
    the event alone; there a micro-batch bounds the updates."""
    u, cond = updates.select(*_UPD), F.col("event_id") == F.col("_ev")
    if updates.isStreaming:
        v = _viewers(viewers)
    else:
        cells = cut(_cells(updates, bucket_ms), "cells")
        u, v = u.withColumn("_at", floor_div("ts_ms", bucket_ms)), _seats(cells, viewers, bucket_ms)
        cond = cond & (F.col("_at") == F.col("_bucket"))
        hot = hot_cells(cells, viewers, cell_rows, cell_pairs)
        if not hot.isEmpty():
            hot = cut(hot, "hot_cells")
            u = _salted(u, hot, "event_id", "_at", ["entity_id", "seq"])
            v = _salted(v, hot, "_ev", "_bucket", None).withColumnRenamed("_salt", "_seat_salt")
            cond = cond & (F.col("_salt") == F.col("_seat_salt"))
    cond = cond & (F.col("ts_ms") > F.col("subscribed_ms")) & (F.col("left_ms").isNull() | (F.col("ts_ms") <= F.col("left_ms")))
    return u.join(v, cond, "inner").select("viewer_id", *_UPD, "subscribed_ms")


def _versions(updates: DataFrame, chunk_ms: int) -> DataFrame:
    """Each update with the time of the next update of its key (null: still latest)."""
    return sequence_features(updates.select(*_UPD), C.KEY, C.ORDER, floor_div("ts_ms", chunk_ms), next=["ts_ms"])


def _visible_at(t, ttl_ms: int, sweep_ms: int, origin_ms: int, read_ttl: bool):
    """C5's visibility of a row at reader time ``t`` (a column)."""
    ttl = (ttl_ms // 1000) * 1000
    if read_ttl:
        return F.col("ts_ms") > t - F.lit(ttl)
    k = floor_div(t - F.lit(origin_ms), sweep_ms)
    last = F.lit(origin_ms) + k * F.lit(sweep_ms)
    return (k < 1) | (F.col("ts_ms") > last - F.lit(ttl))


def _snapshot_bucket(t, ttl_ms: int, sweep_ms: int, origin_ms: int, bucket_ms: int):
    """Bucket of a subscription time.  All times before the first sweep, when
    rows of any age are visible, are one bucket."""
    return F.greatest(floor_div(t - F.lit(origin_ms + sweep_ms), max(bucket_ms, ttl_ms + sweep_ms)), F.lit(-1).cast("long"))


def _visible_buckets(ttl_ms: int, sweep_ms: int, origin_ms: int, bucket_ms: int):
    """The buckets of the times at which a version can be visible: until the next
    version, and at most ttl + sweep after its own time or to the first sweep.  A
    bucket is no narrower than that, so there are three at most."""
    end = F.greatest(F.col("ts_ms") + F.lit(ttl_ms + sweep_ms), F.lit(origin_ms + sweep_ms).cast("long"))
    args = (ttl_ms, sweep_ms, origin_ms, bucket_ms)
    return F.sequence(_snapshot_bucket(F.col("ts_ms"), *args), _snapshot_bucket(F.least(end, F.col("next_ts_ms")), *args))


def snapshot_for_viewers(updates: DataFrame, viewers: DataFrame, ttl_ms: int, sweep_ms: int,
                         origin_ms: int = 0, read_ttl: bool = False,
                         chunk_ms: int = 86_400_000, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """The snapshot each viewer receives when it subscribes (as-of join).

    Each update is turned into a version valid from its ts until the next update
    of its key; a viewer at time T meets, among the versions of its bucket, those
    with ``ts <= T < next_ts`` -- one row per visible entity, no per-viewer history
    blow-up -- and the sweep-grid visibility of C5 is applied to T."""
    args = (ttl_ms, sweep_ms, origin_ms, bucket_ms)
    ver = _versions(updates, chunk_ms).withColumn("_at", F.explode(_visible_buckets(*args)))
    t, ts = F.col("subscribed_ms"), F.col("ts_ms")
    v = _viewers(viewers).withColumn("_bucket", _snapshot_bucket(t, *args))
    cond = ((F.col("event_id") == F.col("_ev")) & (F.col("_at") == F.col("_bucket")) & (ts <= t)
            & (F.col("next_ts_ms").isNull() | (F.col("next_ts_ms") > t)))
    j = ver.join(v, cond, "inner")
    return j.filter(_visible_at(t, ttl_ms, sweep_ms, origin_ms, read_ttl)) \
        .select("viewer_id", *_UPD, "subscribed_ms")


def viewer_stream(updates: DataFrame, viewers: DataFrame, ttl_ms: int, sweep_ms: int,
                  origin_ms: int = 0, chunk_ms: int = 86_400_000, number: bool = True,
                  bucket_ms: int = BUCKET_MS, cell_rows: int = CELL_ROWS, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """D3: what each viewer receives, in order: its snapshot (phase 0, delivered
    at subscription) and then the live updates (phase 1), numbered per viewer
    by (phase, ts, seq) unless ``number`` is False.  Rows are cut exactly once at ``subscribed_ms``.

    One join: an update version stands in the buckets in which it can be part of a
    snapshot (D2, phase 0) and in the bucket of its time, in which it can be live
    (D1, phase 1); a viewer in the bucket of its subscription and in those of its
    seats.  Hot cells of the live part are salted as in D1."""
    args = (ttl_ms, sweep_ms, origin_ms, bucket_ms)
    t, ts = F.col("subscribed_ms"), F.col("ts_ms")
    place = lambda phase, bucket: F.struct(F.lit(phase).alias("phase"), bucket.alias("bucket"))
    places = F.concat(F.transform(_visible_buckets(*args), lambda b: place(0, b)), F.array(place(1, floor_div("ts_ms", bucket_ms))))
    ver = _versions(updates, chunk_ms).withColumn("_place", F.explode(places)) \
        .select("*", F.col("_place.phase").alias("phase"), F.col("_place.bucket").alias("_at")).drop("_place")
    cells = cut(_cells(updates, bucket_ms), "cells")
    v = _viewers(viewers).withColumn("_bucket", _snapshot_bucket(t, *args)).withColumn("_phase", F.lit(0)) \
        .unionByName(_seats(cells, viewers, bucket_ms).withColumn("_phase", F.lit(1)))
    block = F.lit(True)
    hot = hot_cells(cells, viewers, cell_rows, cell_pairs)
    if not hot.isEmpty():
        hot = cut(hot, "hot_cells")
        ver = _salted(ver.withColumn("_live_ev", F.when(F.col("phase") == 1, F.col("event_id"))), hot, "_live_ev", "_at", ["entity_id", "seq"])
        v = _salted(v.withColumn("_seat_ev", F.when(F.col("_phase") == 1, F.col("_ev"))), hot, "_seat_ev", "_bucket", None).withColumnRenamed("_salt", "_seat_salt")
        block = F.col("_salt") == F.col("_seat_salt")
    snap = (ts <= t) & (F.col("next_ts_ms").isNull() | (F.col("next_ts_ms") > t))
    live = (ts > t) & (F.col("left_ms").isNull() | (ts <= F.col("left_ms")))
    j = ver.join(v, (F.col("event_id") == F.col("_ev")) & (F.col("phase") == F.col("_phase")) & (F.col("_at") == F.col("_bucket")) & block
                 & F.when(F.col("phase") == 0, snap).otherwise(live), "inner")
    j = j.filter((F.col("phase") == 1) | _visible_at(F.col("subscribed_ms"), ttl_ms, sweep_ms, origin_ms, False))
    both = j.select("viewer_id", *_UPD, "subscribed_ms", "phase",
                    F.when(F.col("phase") == 0, F.col("subscribed_ms")).otherwise(F.col("ts_ms"))
                    .alias("deliver_ms"))
    if not number:
        return both
    both = cut(both, "viewer_stream")
    order = ["deliver_ms", "phase", "ts_ms", "seq", "entity_id"]
    return sequence_features(both, ["viewer_id"], order, floor_div("deliver_ms", chunk_ms),
                             running={"msg_no": Running(F.lit(1).cast("long"), "sum")})


def viewer_view_at(stream: DataFrame, at_ms: int) -> DataFrame:
    """The table a viewer shows at ``at``: latest row per entity of everything
    delivered so far; the viewer never expires rows."""
    got = stream.filter(F.col("deliver_ms") <= F.lit(at_ms))
    return C.latest_locations(got.select("viewer_id", *_UPD), keys=["viewer_id", "event_id", "entity_id"])


def stale_in_view(view: DataFrame, live: DataFrame, at_ms: int) -> DataFrame:
    """Rows a viewer still shows though the store has dropped them, with
    their age at ``at``.  Anti join on (event, entity)."""
    lv = live.select("event_id", "entity_id")
    return view.join(lv, ["event_id", "entity_id"], "left_anti") \
        .withColumn("age_ms", F.lit(at_ms) - F.col("ts_ms"))


def delivered_ids(deliveries: DataFrame) -> DataFrame:
    """Distinct (event, entity id) pairs seen in delivery metrics."""
    ids = deliveries.select("event_id", F.explode(split_ids("skater_ids", "|")).alias("entity_id"))
    return ids.distinct()


def isolation_check(deliveries: DataFrame) -> DataFrame:
    """Entity ids seen in more than one event (expected: none), with the
    number of events.  Two partial aggregations, no per-id collection."""
    per = delivered_ids(deliveries)
    return per.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_events")) \
        .filter(F.col("n_events") > 1)


def shared_ids(deliveries: DataFrame, event_a: str, event_b: str) -> DataFrame:
    """D5 for one pair of events: ids seen in both."""
    per = delivered_ids(deliveries)
    a = per.filter(F.col("event_id") == event_a).select("entity_id")
    b = per.filter(F.col("event_id") == event_b).select("entity_id")
    return a.intersect(b)


def event_pairs(deliveries: DataFrame, block: int = 1000) -> DataFrame:
    """D5 for all pairs: (event_a, event_b, n_ids) for every two events that share
    an id, event_a < event_b.

    Counted from the inverted lists, id to events.  Ids with the same set of
    events are one list with a weight: sets are told by their size and two
    exclusive ors of hashes, so that ids seen in all events, the usual way in
    which isolation fails, cost one list in all.  A list of k events is cut into
    blocks of ``block`` events by hash; two blocks meet in one cell, so no task
    makes the pairs of a whole list, and pairs are summed before the shuffle."""
    per = cut(delivered_ids(deliveries), "delivered_ids")
    mark = [F.bit_xor(F.xxhash64("event_id")), F.bit_xor(F.xxhash64("event_id", F.lit(1)))]
    sets = per.groupBy("entity_id").agg(F.count(F.lit(1)).alias("k"), *(m.alias(f"mark{i}") for i, m in enumerate(mark))).filter(F.col("k") > 1)
    lists = cut(sets.groupBy("k", "mark0", "mark1").agg(F.count(F.lit(1)).alias("n_ids"), F.min("entity_id").alias("entity_id")).select("entity_id", "k", "n_ids"), "event_sets")
    n = F.ceil(F.col("k") / block).cast("int")
    rows = per.join(lists, "entity_id").select("entity_id", "event_id", "n_ids", n.alias("_n"), F.pmod(F.xxhash64("event_id", F.lit(2)), n).cast("int").alias("_own"))
    first = rows.select("entity_id", F.col("event_id").alias("_a"), "n_ids", F.col("_own").alias("_i"), F.explode(F.sequence(F.col("_own"), F.col("_n") - 1)).alias("_j"))
    second = rows.select("entity_id", F.col("event_id").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"))
    met = first.join(second, ["entity_id", "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_b")))
    return met.groupBy(F.least("_a", "_b").alias("event_a"), F.greatest("_a", "_b").alias("event_b")).agg(F.sum("n_ids").alias("n_ids"))
