"""Exact "group within (size, interval)" without one task per key.

The rule is sequential: a group opens at a row and closes after ``size`` rows
or at the first row ``interval`` or more after it opened (that row opens the
next group).  If a group opens at row ``i`` of a key, the next one opens at

    next(i) = min(i + size, first j > i with t_j - t_i >= interval)

which depends only on the ``size - 1`` rows after ``i``.  So the rows of a key
are numbered and cut into chunks of ``chunk_rows`` rows; each chunk also sees
the first ``size - 1`` rows of the next chunk (its halo).  Which row of a chunk
opens its first group (the *entry*, always one of its first ``size`` rows)
depends on the chunks before it, so every chunk is summarised as a function of
its entry: the entry of the next chunk, the groups opened and the open time of
the last of them -- ``size`` values each, whatever the chunk length.

These functions are composed in a two-level tree: ``chunk_rows`` chunks form a
block, and the blocks of one key are resolved in order in one small group
(a key of 10^12 rows at 65,536 rows per chunk has 233 blocks).  The resolved
entry states flow back down -- block to chunk to row -- through co-grouped
passes on the same hash partitioning.  Every Python group holds at most
``chunk_rows + size - 1`` rows or ``chunk_rows`` chunk summaries.

Only keys, places and times go through Python, and only the rows that open a
group come back.  The rows themselves, packed, shuffle once by chunk (plus the
numbering, see ``sequence_features``) and take the last opening at or before
their place in a window over the chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loctrack.functions import floor_div
from loctrack.operators.sequence import Running, sequence_features

NONE = np.iinfo(np.int64).min      # "no group opened here" in the open-time tables
_ARR = T.ArrayType(T.LongType())


def next_open(t: np.ndarray, n_own: int, size: int, interval_ms: int) -> np.ndarray:
    """``next(i)`` for the first ``n_own`` rows of ``t`` (own rows followed by
    the halo).  Index ``>= len(t)`` means past the end of the key."""
    i = np.arange(n_own, dtype=np.int64)
    nxt = i + size
    for d in range(size - 1, 0, -1):          # the smallest d wins
        j = i + d
        ok = j < len(t)
        hit = np.zeros(n_own, dtype=bool)
        hit[ok] = (t[j[ok]] - t[:n_own][ok]) >= interval_ms
        nxt = np.where(hit, j, nxt)
    return nxt


def _jumps(nxt: np.ndarray, size: int) -> np.ndarray:
    """``next`` over the own rows and the ``size`` places behind them, which stay
    where they are."""
    return np.concatenate([nxt, len(nxt) + np.arange(size, dtype=np.int64)])


def chunk_function(t: np.ndarray, n_own: int, size: int, interval_ms: int):
    """(exit, groups opened, last open time) for each entry ``0 .. size-1``.

    All chains of groups advance together by pointer doubling: after k rounds a
    place stands ``2^k`` groups further."""
    to = _jumps(next_open(t, n_own, size, interval_ms), size)
    own = np.arange(n_own + size, dtype=np.int64) < n_own
    opened, last = own.astype(np.int64), np.where(own, np.arange(n_own + size), -1)
    while (to < n_own).any():
        opened, last, to = opened + opened[to], np.maximum(last, last[to]), to[to]
    e = np.arange(size, dtype=np.int64)
    at = last[e]
    return to[e] - n_own, opened[e], np.where(at >= 0, t[np.maximum(at, 0)], NONE)


def opening_rows(nxt: np.ndarray, entry: int, size: int) -> np.ndarray:
    """Whether each own row opens a group, given the first one that does: the
    places reached from ``entry``, by doubled jumps from the longest down."""
    jumps = [_jumps(nxt, size)]
    while (jumps[-1] < len(nxt)).any():
        jumps.append(jumps[-1][jumps[-1]])
    start = np.zeros(len(nxt) + size, dtype=bool)
    start[entry] = True
    for jump in reversed(jumps):
        start[jump[np.flatnonzero(start)]] = True
    return start[:len(nxt)]


def compose(funcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int):
    """The function of a run of consecutive units (given in order)."""
    cur = np.arange(size, dtype=np.int64)
    tot = np.zeros(size, dtype=np.int64)
    last = np.full(size, NONE, dtype=np.int64)
    for ex, cn, lo in funcs:
        tot = tot + cn[cur]
        v = lo[cur]
        last = np.where(v != NONE, v, last)
        cur = ex[cur]
    return cur, tot, last


def walk(state: tuple[int, int, int], funcs, size: int) -> list[tuple[int, int, int]]:
    """Entry states (entry, groups before, open time carried in) of each unit."""
    e, before, carry = state
    out = []
    for ex, cn, lo in funcs:
        out.append((e, before, carry))
        before += int(cn[e])
        if lo[e] != NONE:
            carry = int(lo[e])
        e = int(ex[e])
    return out


def _arrays(pdf: pd.DataFrame):
    return [(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64), np.asarray(c, dtype=np.int64))
            for a, b, c in zip(pdf["ex"], pdf["cn"], pdf["lo"])]


def group_within(rows: DataFrame, key, size: int, interval_ms: int, ts: str = "ts_ms",
                 order=("ts_ms", "seq"), chunk_rows: int = 65_536,
                 time_chunk_ms: int = 86_400_000, position: str | None = None) -> DataFrame:
    """Rows plus ``group_no`` (0-based per key, in ``order``) and
    ``group_open_ms`` (``ts`` of the group's first row).  ``order`` must be a
    total order within a key; ``time_chunk_ms`` cuts the numbering pass.
    ``position`` names a column that already holds the 1-based consecutive
    position of each row in ``order`` within its key (then no numbering pass)."""
    keys = [key] if isinstance(key, str) else list(key)
    size = max(int(size), 1)
    ch = max(int(chunk_rows), size)
    cols = rows.columns
    kfields = [rows.schema[k] for k in keys]

    if position is None:
        numbered = sequence_features(rows, keys, list(order), floor_div(ts, time_chunk_ms),
                                     running={"_rn": Running(F.lit(1), "sum")})
        rn = F.col("_rn") - F.lit(1)
    else:
        numbered, rn = rows, F.col(position).cast("long") - F.lit(1)
    own = numbered.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), *keys, F.col(ts).cast("long").alias("_t"),
                          floor_div(rn, ch).alias("_c"), (rn % F.lit(ch)).alias("_i"))
    times = own.drop("_row")
    halo = times.filter((F.col("_i") < F.lit(size - 1)) & (F.col("_c") > 0)) \
        .withColumn("_c", F.col("_c") - 1).withColumn("_i", F.col("_i") + F.lit(ch))
    pts = times.unionByName(halo)
    by_chunk = pts.groupBy(*keys, "_c")

    fn_schema = T.StructType([*kfields, T.StructField("_c", T.LongType()), T.StructField("_b", T.LongType()),
                              T.StructField("ex", _ARR), T.StructField("cn", _ARR), T.StructField("lo", _ARR)])

    def level0(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        t = pdf["_t"].to_numpy(dtype=np.int64)
        n_own = int((pdf["_i"] < ch).sum())
        ex, cn, lo = chunk_function(t, n_own, size, interval_ms)
        c = int(pdf["_c"].iloc[0])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_c": [c], "_b": [c // ch],
                             "ex": [ex], "cn": [cn], "lo": [lo]})

    chunks = by_chunk.applyInPandas(level0, fn_schema)
    blocks_in = chunks.groupBy(*keys, "_b")

    def level1(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_c")
        ex, cn, lo = compose(_arrays(pdf), size)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_b": [int(pdf["_b"].iloc[0])],
                             "ex": [ex], "cn": [cn], "lo": [lo]})

    blk_schema = T.StructType([*kfields, T.StructField("_b", T.LongType()), T.StructField("ex", _ARR),
                               T.StructField("cn", _ARR), T.StructField("lo", _ARR)])
    blocks = blocks_in.applyInPandas(level1, blk_schema)

    st_fields = [T.StructField("_e", T.LongType()), T.StructField("_before", T.LongType()),
                 T.StructField("_carry", T.LongType())]
    blk_state_schema = T.StructType([*kfields, T.StructField("_b", T.LongType()), *st_fields])

    def top(pdf: pd.DataFrame) -> pd.DataFrame:      # all blocks of one key
        pdf = pdf.sort_values("_b")
        states = walk((0, 0, NONE), _arrays(pdf), size)
        out = pdf[[*keys, "_b"]].copy()
        out["_e"], out["_before"], out["_carry"] = ([s[0] for s in states], [s[1] for s in states],
                                                    [s[2] for s in states])
        return out

    blk_states = blocks.groupBy(*keys).applyInPandas(top, blk_state_schema)

    chunk_state_schema = T.StructType([*kfields, T.StructField("_c", T.LongType()), *st_fields])

    def down(fns: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:   # chunks of one block
        if fns.empty:
            return pd.DataFrame({c.name: [] for c in chunk_state_schema.fields})
        fns = fns.sort_values("_c")
        s0 = st.iloc[0]
        states = walk((int(s0["_e"]), int(s0["_before"]), int(s0["_carry"])), _arrays(fns), size)
        out = fns[[*keys, "_c"]].copy()
        out["_e"], out["_before"], out["_carry"] = ([s[0] for s in states], [s[1] for s in states],
                                                    [s[2] for s in states])
        return out

    chunk_states = blocks_in.cogroup(blk_states.groupBy(*keys, "_b")).applyInPandas(down, chunk_state_schema)

    opening = T.StructType([T.StructField("group_no", T.LongType()), T.StructField("group_open_ms", T.LongType())])
    mark_schema = T.StructType([*kfields, T.StructField("_c", T.LongType()), T.StructField("_i", T.LongType()), *opening.fields])

    def openings(pdf: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:   # rows of one chunk
        if pdf.empty:
            return pd.DataFrame({c.name: [] for c in mark_schema.fields})
        pdf = pdf.sort_values("_i")
        t = pdf["_t"].to_numpy(dtype=np.int64)
        n_own = int((pdf["_i"] < ch).sum())
        s0 = st.iloc[0]
        e, before, carry = int(s0["_e"]), int(s0["_before"]), int(s0["_carry"])
        at = np.flatnonzero(opening_rows(next_open(t, n_own, size, interval_ms), e, size))
        # the group that an earlier chunk opened stands before the first row
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "_c": int(pdf["_c"].iloc[0]), "_i": np.concatenate([[-1], at]),
                             "group_no": before - 1 + np.arange(len(at) + 1), "group_open_ms": np.concatenate([[carry], t[at]])})

    marks = by_chunk.cogroup(chunk_states.groupBy(*keys, "_c")).applyInPandas(openings, mark_schema)
    both = own.select("_row", *keys, "_c", "_i", F.lit(None).cast(opening).alias("_g")).unionByName(
        marks.select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), *keys, "_c", "_i", F.struct("group_no", "group_open_ms").alias("_g")))
    w = Window.partitionBy(*keys, "_c").orderBy("_i", F.col("_g").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_open", F.last("_g", ignorenulls=True).over(w)).filter(F.col("_row").isNotNull())
    return filled.select(*[F.col(f"_row.`{c}`").alias(c) for c in cols], "_open.group_no", "_open.group_open_ms")
