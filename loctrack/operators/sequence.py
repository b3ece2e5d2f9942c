"""Ordered per-key features that survive one hot key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts all rows of a key in one
task; if one key holds a third of the data that task is the whole job.  Here the
rows of a key are first cut into time chunks (a monotone function of the first
ordering column).  Every chunk is handled by a windowed sort of its own, and the
chunk borders are stitched through a small summary table with one row per
(key, chunk): the last row of the previous chunk, the first row of the next
chunk and the running totals of all earlier chunks.  The summary grows with the
number of chunks, not with the rows, and joins back on the same hash
partitioning as the windowed rows, so the rows themselves shuffle once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A (key, chunk) cell with more rows than this is cut further before its sort.
MAX_CHUNK_ROWS = 2_000_000
# Sampled places per bound of rows, of which every fourth becomes a border.
_SAMPLES = 16
# Borders of a group in the search for a row's sub-chunk.
_GROUP = 64


@dataclass(frozen=True)
class Running:
    """A running aggregate over the rows of a key in order."""
    value: Column
    how: str = "sum"          # sum | max | min
    inclusive: bool = True    # include the current row


_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(how: str, before: Column, local: Column) -> Column:
    if how == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
    if how == "max":
        return F.greatest(before, local)
    return F.least(before, local)


def _grouped(borders: Column) -> Column:
    """Sorted borders in groups of ``_GROUP``."""
    n = F.ceil(F.size(borders) / _GROUP).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(borders, i * _GROUP + 1, F.lit(_GROUP)))).otherwise(F.array(F.slice(borders, F.lit(1), F.lit(0))))


def _borders_below(groups: str, place: Column) -> Column:
    """How many borders lie before ``place``: the groups that begin before it are
    counted, then the borders of the last one, so a row meets one border of each
    group and ``_GROUP`` more, not all of them."""
    full = F.size(F.filter(groups, lambda g: (F.size(g) > 0) & (F.get(g, F.lit(0)) < place)))
    last = F.get(F.col(groups), full - 1)
    return F.when(full == 0, F.lit(0)).otherwise((full - 1) * _GROUP + F.size(F.filter(last, lambda b: b < place)))


def split_hot_chunks(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                     max_rows: int | None = MAX_CHUNK_ROWS) -> DataFrame:
    """``df`` with ``_chunk``: ``chunk``, and for the few (key, chunk) cells
    holding more than ``max_rows`` rows, a sub-chunk between quantile borders of
    the whole ``order`` tuple (about 4 sub-chunks per ``max_rows`` rows).

    One pass counts the rows of each cell (a partial hash aggregation of numbers
    alone, nothing is sorted); where there are hot cells, a second one samples their
    places by a hash of the order tuple, so the borders are the same whenever
    they are computed.  Rows that share a time are cut by the other order
    columns; only rows equal in all of them stay together.  Hot cells are at
    most rows / ``max_rows`` in number, with ``_SAMPLES / 4`` borders per bound of
    rows, which bounds the broadcast: about 100 MB for 10^12 rows, all hot.
    Cold cells keep sub-chunk 0, so the result is the same as without splitting
    -- only the sorts are spread over more tasks."""
    base = df.withColumn("_chunk0", chunk)
    if not max_rows:
        return base.withColumnRenamed("_chunk0", "_chunk")
    place = F.struct(*[F.col(c) for c in order])
    full = base.groupBy(*keys, "_chunk0").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > F.lit(max_rows)) \
        .select(*[F.col(k).alias(f"_fk{i}") for i, k in enumerate(keys)], F.col("_chunk0").alias("_fc"))
    in_full = F.col("_chunk0") == F.col("_fc")
    for i, k in enumerate(keys):
        in_full = in_full & F.col(k).eqNullSafe(F.col(f"_fk{i}"))
    sampled = base.filter(F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(max(1, max_rows // _SAMPLES))) == 0) \
        .join(F.broadcast(full), in_full)
    hot = sampled.groupBy(*keys, "_chunk0").agg(F.collect_list(place).alias("_s")) \
        .select(*[F.col(k).alias(f"_hk{i}") for i, k in enumerate(keys)], F.col("_chunk0").alias("_hc"),
                _grouped(F.filter(F.array_sort("_s"), lambda _, i: i % 4 == 3)).alias("_borders"))
    cond = F.col("_chunk0") == F.col("_hc")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_hk{i}"))
    j = base.join(F.broadcast(hot), cond, "left")
    sub = F.when(F.col("_hc").isNull(), F.lit(0)).otherwise(_borders_below("_borders", place))
    return j.withColumn("_chunk", F.struct(F.col("_chunk0").alias("c"), sub.alias("s"))) \
        .select(*df.columns, "_chunk")


def sequence_features(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                      prev: list[str] = (), next: list[str] = (),
                      running: dict[str, Running] | None = None,
                      max_chunk_rows: int | None = MAX_CHUNK_ROWS) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>`` (the neighbouring row of the same key in
    ``order``) and running aggregates to every row.

    ``order`` must be a total order within a key; ``chunk`` must not decrease
    along it (e.g. ``floor(ts / width)``).  Cells of more than
    ``max_chunk_rows`` rows are cut further (``split_hot_chunks``).
    """
    running = running or {}
    carry_prev, carry_next = list(prev), list(next)
    w_local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    loc = split_hot_chunks(df, keys, order, chunk, max_chunk_rows)
    if carry_prev:
        loc = loc.withColumn("_lp", F.lag(F.struct(*carry_prev)).over(w_local))
    if carry_next:
        loc = loc.withColumn("_ln", F.lead(F.struct(*carry_next)).over(w_local))
    for name, r in running.items():
        frame = w_local.rowsBetween(Window.unboundedPreceding,
                                    Window.currentRow if r.inclusive else -1)
        loc = (loc.withColumn(f"_v_{name}", r.value)
                  .withColumn(f"_lr_{name}", _LOCAL[r.how](F.col(f"_v_{name}")).over(frame)))

    # one row per (key, chunk): borders and chunk totals
    ord_struct = F.struct(*order)
    aggs = []
    if carry_prev:
        aggs.append(F.max_by(F.struct(*carry_prev), ord_struct).alias("_last"))
    if carry_next:
        aggs.append(F.min_by(F.struct(*carry_next), ord_struct).alias("_first"))
    for name, r in running.items():
        aggs.append(_LOCAL[r.how](F.col(f"_v_{name}")).alias(f"_t_{name}"))
    if not aggs:
        return df
    summ = loc.groupBy(*keys, "_chunk").agg(*aggs)
    w_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    before = w_chunks.rowsBetween(Window.unboundedPreceding, -1)
    cols = [*[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_schunk")]
    if carry_prev:
        cols.append(F.lag("_last").over(w_chunks).alias("_cp"))
    if carry_next:
        cols.append(F.lead("_first").over(w_chunks).alias("_cn"))
    for name, r in running.items():
        cols.append(_LOCAL[r.how](F.col(f"_t_{name}")).over(before).alias(f"_cb_{name}"))
    summ = summ.select(*cols)

    cond = [F.col(k).eqNullSafe(F.col(f"_sk{i}")) for i, k in enumerate(keys)]
    cond.append(F.col("_chunk") == F.col("_schunk"))
    c = cond[0]
    for x in cond[1:]:
        c = c & x
    j = loc.join(summ, c, "left")
    out = [F.col(c) for c in df.columns]
    for c in carry_prev:
        out.append(F.when(F.col("_lp").isNull(), F.col("_cp")[c]).otherwise(F.col("_lp")[c])
                   .alias(f"prev_{c}"))
    for c in carry_next:
        out.append(F.when(F.col("_ln").isNull(), F.col("_cn")[c]).otherwise(F.col("_ln")[c])
                   .alias(f"next_{c}"))
    for name, r in running.items():
        out.append(_combine(r.how, F.col(f"_cb_{name}"), F.col(f"_lr_{name}")).alias(name))
    return j.select(*out)


def running_flag_count(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                       carry: list[str], flag, name: str, keep_prev: bool = False,
                       max_chunk_rows: int | None = MAX_CHUNK_ROWS) -> DataFrame:
    """Running count (inclusive) of ``flag(prev, cur)`` per key in one pass,
    where ``prev``/``cur`` are structs of the ``carry`` columns of the previous
    and the current row (``prev`` is null on a key's first row).

    Rows after the first in a chunk see their neighbour in the chunk's window;
    the flag of each chunk's first row needs the previous chunk's last row and
    is settled on the small (key, chunk) summary, together with the counts of
    all earlier chunks.  Used for session starts and day roll-overs."""
    w_local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    cur = F.struct(*carry)
    loc = split_hot_chunks(df, keys, order, chunk, max_chunk_rows).withColumn("_lp", F.lag(cur).over(w_local))
    local_flag = F.when(F.col("_lp").isNull(), F.lit(0)) \
        .otherwise(flag(F.col("_lp"), cur).cast("long"))
    loc = loc.withColumn("_lf", local_flag).withColumn(
        "_lr", F.sum("_lf").over(w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ord_struct = F.struct(*order)
    summ = loc.groupBy(*keys, "_chunk").agg(F.min_by(cur, ord_struct).alias("_first"),
                                            F.max_by(cur, ord_struct).alias("_last"),
                                            F.sum("_lf").alias("_tot"))
    w_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    summ = summ.withColumn("_pl", F.lag("_last").over(w_chunks))
    summ = summ.withColumn("_ff", F.coalesce(flag(F.col("_pl"), F.col("_first")), F.lit(False)).cast("long"))
    summ = summ.withColumn("_off", F.coalesce(F.sum(F.col("_tot") + F.col("_ff")).over(
        w_chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    summ = summ.select(*[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)],
                       F.col("_chunk").alias("_schunk"), "_pl", "_ff", "_off")
    c = F.col("_chunk") == F.col("_schunk")
    for i, k in enumerate(keys):
        c = c & F.col(k).eqNullSafe(F.col(f"_sk{i}"))
    j = loc.join(summ, c, "left")
    out = [F.col(x) for x in df.columns]
    out.append((F.col("_off") + F.col("_ff") + F.col("_lr")).alias(name))
    if keep_prev:
        for x in carry:
            out.append(F.when(F.col("_lp").isNull(), F.col("_pl")[x]).otherwise(F.col("_lp")[x])
                       .alias(f"prev_{x}"))
    return j.select(*out)
