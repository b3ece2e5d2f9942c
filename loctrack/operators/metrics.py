"""Summaries over publish and delivery metrics and over the update
history (rates, gauges, histograms, bandwidth)."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loctrack import schemas as S
from loctrack.functions import ceil_div, floor_div, grid_ceil, grid_floor, split_ids
from loctrack.operators.sequence import Running, sequence_features
from loctrack.session import cut

DEFAULT_PS = (0.5, 0.95, 0.99)


def _is_error(c: str = "error") -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def record_counts(metrics: DataFrame, by: list[str] = ("event_id",)) -> DataFrame:
    """G1: rows per key (e.g. event, or ``input_file_name()`` for per-file counts)."""
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"))


def error_class(c: str = "error") -> Column:
    """Class of an error text by its known prefix; '' for no error, 'other' else."""
    e = F.coalesce(F.col(c), F.lit(""))
    out = F.when(e == "", F.lit(""))
    for p in sorted(S.ERROR_PREFIXES, key=len, reverse=True):
        out = out.when(e.startswith(p), F.lit(p))
    return out.otherwise(F.lit("other"))


def error_summary(metrics: DataFrame, by: list[str] = ("event_id",)) -> DataFrame:
    """Rows, error rows and error rate per key."""
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"),
                                    F.count_if(_is_error()).alias("n_errors")) \
        .withColumn("error_rate", F.col("n_errors") / F.col("n_records"))


def error_classes(metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    """Error rows per class (message prefix)."""
    return metrics.filter(_is_error()).groupBy(*by, error_class().alias("error_class")) \
        .agg(F.count(F.lit(1)).alias("n_errors"))


def seen_entities(deliveries: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct entity ids seen per event in the '|'-joined id lists.
    ``approx=True`` uses a HyperLogLog sketch instead of an exact distinct."""
    ids = deliveries.select("event_id", F.explode(split_ids("skater_ids", "|")).alias("entity_id"))
    if approx:
        return ids.groupBy("event_id").agg(F.approx_count_distinct("entity_id").alias("n_entities"))
    return ids.distinct().groupBy("event_id").agg(F.count(F.lit(1)).alias("n_entities"))


def expected_count_check(metrics: DataFrame, entities: int | Column, interval_s: int,
                         minutes: int, tol: float = 0.1, by: list[str] = ("event_id",)) -> DataFrame:
    """Actual rows per key against entities * (60 div interval) * minutes,
    accepted within +-tol of the expected count (rounded down, in decimal
    arithmetic, so any tolerance is exact)."""
    per_min = 60 // interval_s
    ent = entities if isinstance(entities, Column) else F.lit(entities)
    c = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("actual"),
                                 F.count_distinct("skater_id").alias("n_entities"))
    ent = F.col("n_entities") if entities is None else ent
    exp = (ent * F.lit(per_min) * F.lit(minutes)).cast("long")
    delta = F.floor(exp.cast("decimal(20,0)") * F.lit(Decimal(str(tol)))).cast("long")
    return c.withColumn("expected", exp).withColumn("allowed_delta", delta) \
        .withColumn("within", F.abs(F.col("actual") - F.col("expected")) <= F.col("allowed_delta"))


def _names(ps) -> list[str]:
    return [f"p{int(round(p * 100))}" for p in ps]


def value_summary(df: DataFrame, keys: list[str], value: str, exact: bool = True, ps=DEFAULT_PS,
                  counts: dict[str, Callable[[Column], Column]] | None = None, cells: int = 256) -> DataFrame:
    """n, min, mean, max and linear-interpolated percentiles of ``value`` per
    key, and how many values fulfil each condition of ``counts``.

    No task holds a group.  Rows are counted per (key, value) with partial
    aggregation, and all the rest works on these counts: a running count over
    the values of a key, cut into ``cells`` chunks of the key's own value range
    (the chunked sequence helper, which cuts fuller chunks further), gives each
    value its range of ranks, and one aggregation picks the two values around
    each percentile's rank.  Null keys are a group; NaN sorts behind all values;
    without keys the whole table is one group.

    ``exact=False`` uses ``percentile_approx`` (one pass, bounded memory)."""
    counts, keys = counts or {}, list(keys)
    v, names = F.col(value), _names(ps)
    src = df.filter(v.isNotNull())
    if not exact:
        extra = [F.count_if(f(v)).alias(k) for k, f in counts.items()]
        pa = F.percentile_approx(value, list(ps), 10000).alias("_pa")
        out = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"),
                                     F.max(value).alias("max"), *extra, pa)
        return out.select(*keys, "n", "min", "mean", "max", *[F.col("_pa")[i].cast("double").alias(k) for i, k in enumerate(names)], *counts)
    by = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    src = src.select(*([F.col(k).alias(b) for k, b in zip(keys, by)] or [F.lit(0).alias("_k0")]), v.cast("double").alias("_x"))
    x, c = F.col("_x"), F.col("_c")
    vc = cut(src.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c")), "value_counts")
    finite = F.when(~F.isnan(x) & (F.abs(x) < 1e300), x)
    stats = vc.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.min("_x").alias("min"), (F.sum(x * c) / F.sum("_c")).alias("mean"), F.max("_x").alias("max"),
        F.min(finite).alias("_lo"), F.max(finite).alias("_hi"),
        *[F.coalesce(F.sum(F.when(f(x), c)), F.lit(0)).alias(k) for k, f in counts.items()]) \
        .select(*[F.col(b).alias(f"_s{b}") for b in by], "n", "min", "mean", "max", "_lo", "_hi", *counts)
    same = [F.col(b).eqNullSafe(F.col(f"_s{b}")) for b in by]
    on = same[0]
    for e in same[1:]:
        on = on & e
    width = F.greatest((F.col("_hi") - F.col("_lo")) / F.lit(float(cells)), F.lit(1e-9))
    chunk = F.when(F.isnan(x) | (x >= 1e300), F.lit(cells + 1)).when(x <= -1e300, F.lit(-1)) \
        .otherwise(F.least(F.floor((x - F.col("_lo")) / width), F.lit(cells)).cast("int"))
    j = vc.join(stats, on).withColumn("_cell", chunk)
    cum = sequence_features(j, by, ["_x"], F.col("_cell"), running={"_cum": Running(c, "sum")})

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") - c <= rank) & (rank < F.col("_cum")), x))

    picks = []
    for p, name in zip(ps, names):
        h = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        picks += [at(F.floor(h)).alias(f"_a{name}"), at(F.ceil(h)).alias(f"_b{name}")]
    first = [F.first(k).alias(k) for k in ("n", "min", "mean", "max", *counts)]
    out = cum.groupBy(*by).agg(*first, *picks)
    ends = []
    for p, name in zip(ps, names):
        h = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        lo, hi = F.col(f"_a{name}"), F.col(f"_b{name}")
        ends.append(F.when(lo == hi, lo).otherwise(lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return out.select(*[F.col(b).alias(k) for k, b in zip(keys, by)], "n", "min", "mean", "max", *ends, *counts)


def response_time_summary(metrics: DataFrame, by: list[str] = ("event_id",), exact: bool = True) -> DataFrame:
    """Response time min, mean, max, p50, p95, p99 per key (successful rows)."""
    ok = metrics.filter(~_is_error())
    return value_summary(ok, list(by), "response_time_ms", exact)


def delivery_latency(deliveries: DataFrame) -> DataFrame:
    """G6 rows: receive - serverTime in ms for decoded messages; negative
    latencies (clock skew, or the receive time taken before the read) flagged."""
    ok = deliveries.filter(~_is_error() & F.col("server_ms").isNotNull())
    lat = F.col("receive_ms") - F.col("server_ms")
    return ok.withColumn("latency_ms", lat.cast("double")).withColumn("negative", lat < 0)


def delivery_latency_summary(deliveries: DataFrame, by: list[str] = ("event_id",),
                             exact: bool = True) -> DataFrame:
    """G6 summary per key, with the count of negative latencies."""
    lat = delivery_latency(deliveries)
    return value_summary(lat, list(by), "latency_ms", exact, counts={"n_negative": lambda v: v < 0})


def explode_locations(batches: DataFrame, keys: list[str]) -> DataFrame:
    return batches.select(*keys, "serverTime", F.posexplode("locations").alias("pos", "loc")) \
        .select(*keys, "serverTime", "pos", F.col("loc.skaterId").alias("entity_id"),
                F.col("loc.timestamp").alias("ts_ms"))


def batching_delay(batches: DataFrame, keys: list[str] = ("viewer_id",)) -> DataFrame:
    """serverTime - location timestamp for every location in a batch."""
    return explode_locations(batches, list(keys)) \
        .withColumn("delay_ms", F.col("serverTime") - F.col("ts_ms"))


def publish_to_delivery(updates: DataFrame, delivered: DataFrame) -> DataFrame:
    """End-to-end delay per update and viewer: join the published updates
    with the delivered locations on (event, entity, ts) -- both sides shuffle
    on the same key, a hot event splits by entity and time.

    Updates of a participant that share their time are told apart by their
    order (``seq`` and the place in the batches), so ties don't multiply."""
    key = ["event_id", "entity_id", "ts_ms"]
    tie = F.row_number()
    d = delivered.select("viewer_id", *key, F.col("serverTime").alias("delivered_ms"), "pos",
                         tie.over(Window.partitionBy(*key, "viewer_id").orderBy("serverTime", "pos")).alias("_tie"))
    u = updates.select(*key, "seq", tie.over(Window.partitionBy(*key).orderBy("seq")).alias("_tie"))
    return u.join(d, [*key, "_tie"], "inner").drop("_tie", "pos") \
        .withColumn("delay_ms", F.col("delivered_ms") - F.col("ts_ms"))


def publish_rate(updates: DataFrame, window_ms: int = 60_000, origin_ms: int = 0) -> DataFrame:
    """Accepted updates per window and event, and the per-minute rate."""
    w = grid_floor(F.col("ts_ms"), origin_ms, window_ms)
    return updates.groupBy("event_id", w.alias("window_ms")).agg(F.count(F.lit(1)).alias("n_updates")) \
        .withColumn("per_minute", F.col("n_updates") * F.lit(60_000.0) / F.lit(float(window_ms)))


def active_gauges(presence: DataFrame, lifetimes: DataFrame, viewers: DataFrame,
                  grid_ms: int, origin_ms: int = 0) -> DataFrame:
    """Per grid time point at which anything enters or goes, also where the
    changes cancel: active events, live entities, open viewers.

    ``presence`` and ``lifetimes`` are points (t_ms, delta), see C7; a point
    counts from the first grid point at or after it.  Points are summed per grid
    point (partial aggregation), then a running sum goes over the grid points --
    a table with one row per point, not per interval."""
    def points(df: DataFrame, t: str, delta: Column, name: str) -> DataFrame:
        return df.select(grid_ceil(F.col(t), origin_ms, grid_ms).alias("t_ms"), delta.cast("long").alias(name))

    names = ("d_events", "d_entities", "d_viewers")
    d = points(presence, "t_ms", F.col("delta"), names[0])
    for more in (points(lifetimes, "t_ms", F.col("delta"), names[1]),
                 points(viewers, "subscribed_ms", F.lit(1), names[2]),
                 points(viewers.filter(F.col("left_ms").isNotNull()), "left_ms", F.lit(-1), names[2])):
        d = d.unionByName(more, allowMissingColumns=True)
    per = d.groupBy("t_ms").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names])
    per = per.withColumn("_k", F.lit(0).cast("long"))
    # at most one row per grid point: 30-day chunks hold a bounded number of
    # points (43,200 at a one-minute grid), so no hot-cell count is needed
    out = sequence_features(per, ["_k"], ["t_ms"], floor_div("t_ms", 30 * 86_400_000), max_chunk_rows=None,
                            running={"active_events": Running(F.col("d_events"), "sum"),
                                     "live_entities": Running(F.col("d_entities"), "sum"),
                                     "open_viewers": Running(F.col("d_viewers"), "sum")})
    return out.select("t_ms", "active_events", "live_entities", "open_viewers")


def duration_histogram(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Counts per bucket; bucket i holds values with edges[i-1] <= v < edges[i]
    (bucket 0 below the first edge, bucket len(edges) at or above the last)."""
    e = sorted(float(x) for x in edges)
    b = F.size(F.filter(F.array(*[F.lit(x) for x in e]), lambda x: x <= F.col(col).cast("double")))
    lo = F.element_at(F.array(F.lit(None).cast("double"), *[F.lit(x) for x in e]), b + 1)
    hi = F.element_at(F.array(*[F.lit(x) for x in e], F.lit(None).cast("double")), b + 1)
    return df.filter(F.col(col).isNotNull()).select(b.alias("bucket"), lo.alias("lower"), hi.alias("upper")) \
        .groupBy("bucket", "lower", "upper").agg(F.count(F.lit(1)).alias("n"))


def bandwidth_estimate(updates: DataFrame, bytes_per_update: int = 2048, window_ms: int = 3_600_000,
                       origin_ms: int = 0) -> DataFrame:
    """Estimated bytes per event and hour (updates x message size)."""
    w = grid_floor(F.col("ts_ms"), origin_ms, window_ms)
    return updates.groupBy("event_id", w.alias("window_ms")).agg(F.count(F.lit(1)).alias("n_updates")) \
        .withColumn("bytes", F.col("n_updates") * F.lit(bytes_per_update)) \
        .withColumn("bytes_per_s", F.col("bytes") / F.lit(window_ms / 1000.0))
