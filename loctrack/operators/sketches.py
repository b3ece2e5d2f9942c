"""Stored sketches: distinct ids (G3) and quantiles (G5, G6) of any range of
hours from one small row for each (key, hour).

Both are Spark's own mergeable aggregates, so they combine before the shuffle
and a hot key costs one sketch for each map task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loctrack.functions import floor_div, split_ids

HOUR_MS = 3_600_000
#: Logarithm of the registers of a distinct sketch.
LG_REGISTERS = 12
#: Size of a quantile sketch.
QUANTILE_K = 800


def distinct_bound(lg: int = LG_REGISTERS) -> float:
    """Relative error that an estimate keeps in 997 of 1000 cases (three standard
    errors of a HyperLogLog of 2^lg registers)."""
    return 3 * 1.04 / math.sqrt(1 << lg)


def rank_bound(k: int = QUANTILE_K) -> float:
    """Rank error, as a share of all values, that a quantile keeps: twice the
    99 % bound of a KLL sketch of size k, as sketches are merged."""
    return 2 * 2.296 / k**0.9021


def id_sketches(deliveries: DataFrame, time_col: str = "receive_ms", every_ms: int = HOUR_MS, lg: int = LG_REGISTERS) -> DataFrame:
    """(event_id, hour_ms, ids, n): a mergeable sketch of the delivered ids of each
    event and hour, and how many ids went in; rows without ids give none."""
    ids = deliveries.select("event_id", (floor_div(time_col, every_ms) * every_ms).alias("hour_ms"), F.explode(split_ids("skater_ids", "|")).alias("entity_id"))
    return ids.groupBy("event_id", "hour_ms").agg(F.hll_sketch_agg("entity_id", F.lit(lg)).alias("ids"), F.count(F.lit(1)).alias("n"))


def _in_range(stored: DataFrame, from_ms: int | None, to_ms: int | None) -> DataFrame:
    if from_ms is not None:
        stored = stored.filter(F.col("hour_ms") >= from_ms)
    return stored if to_ms is None else stored.filter(F.col("hour_ms") < to_ms)


def seen_entities_from(stored: DataFrame, by: list[str] = ("event_id",), from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """G3 from the stored sketches: distinct ids for each ``by`` in a range of
    whole hours (``from_ms`` included, ``to_ms`` not)."""
    united = _in_range(stored, from_ms, to_ms).groupBy(*by).agg(F.hll_union_agg("ids").alias("ids"), F.sum("n").alias("n"))
    return united.select(*by, "n", F.hll_sketch_estimate("ids").alias("n_entities"))


def value_sketches(metrics: DataFrame, value: str, time_col: str = "ts_ms", by: list[str] = ("event_id",), every_ms: int = HOUR_MS, k: int = QUANTILE_K) -> DataFrame:
    """(by, hour_ms, n, total, least, most, sketch) of the values of each key and
    hour; null and NaN values are left out."""
    v = F.col(value).cast("double")
    rows = metrics.select(*by, (floor_div(time_col, every_ms) * every_ms).alias("hour_ms"), v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy(*by, "hour_ms").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"),
                                            F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def value_summary_from(stored: DataFrame, by: list[str] = ("event_id",), ranks: dict[str, float] | None = None, from_ms: int | None = None, to_ms: int | None = None, k: int = QUANTILE_K) -> DataFrame:
    """G5 / G6 from the stored sketches: exact n, min, mean and max, and quantiles
    whose rank is off by at most ``rank_bound(k)`` of all values."""
    ranks = ranks or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    whole = _in_range(stored, from_ms, to_ms).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("min"), F.max("most").alias("max"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return whole.select(*by, "n", "min", (F.col("total") / F.col("n")).alias("mean"), "max", *(F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in ranks.items()))


def rank_errors(metrics: DataFrame, value: str, summary: DataFrame, by: list[str] = ("event_id",), ranks: dict[str, float] | None = None) -> DataFrame:
    """How far each quantile of ``summary`` lies from its rank among the exact
    values, as a share: zero where equal values cover the rank."""
    ranks = ranks or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    v = F.col(value).cast("double")
    rows = metrics.select(*(F.col(b).alias(f"_{b}") for b in by), v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    same: Column = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    counts = [F.count_if(F.col("_v") < F.col(p)).alias(f"{p}_below") for p in ranks] + [F.count_if(F.col("_v") <= F.col(p)).alias(f"{p}_upto") for p in ranks]
    met = rows.join(summary, same).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
    off = [F.greatest(F.lit(0.0), F.col(f"{name}_below") / F.col("n") - p, p - F.col(f"{name}_upto") / F.col("n")).alias(f"{name}_error") for name, p in ranks.items()]
    return met.select(*by, "n", *off)
