"""H1-H6: heap samples from recording text, elapsed time, growth line, leak
assessment, run comparison.  Many recordings run in parallel, one group each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loctrack import schemas as S
from loctrack.functions import floor_div
from loctrack.operators.sequence import Running, running_flag_count, sequence_features
from loctrack.session import cut

# Block marker and field patterns of the heap summary text.
BLOCK_START = "jdk.GCHeapSummary"
START_TIME_RE = r"startTime = (.+?)(?:\s*\(|$)"
HEAP_USED_RE = r"heapUsed = ([\d.]+)\s*([A-Z]+)?"
# The two accepted time formats (time of day; ISO date-time with Z).
CLOCK_RE = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})\.(\d{1,6})$"
ISO_RE = r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})\.(\d{1,6})Z$"
DAY_S = 86_400
# Rows of recordings that a task sorts, and lines of a chunk: some chunks a task, so that tasks come out alike.
TASK_ROWS = 200_000
CHUNK_LINES = 50_000


def heap_samples(lines: DataFrame, key: str = "recording", line_no: str = "line_no") -> DataFrame:
    """H1: (recording, sample_no, time_str, heap_mb) from recording lines.

    A block starts at a line beginning with the marker and ends when its brace
    depth returns to 0 (once a field was seen) or at the next marker.  The last
    startTime / heapUsed match of a block wins; heapUsed is scaled by its unit
    (MB, GB x 1024, KB / 1024, otherwise bytes).  A block needs both fields; an
    unclosed final block is dropped.  Windows are per block, so no window
    spans a whole recording.

    Lines without a marker, field name or brace decide nothing and stay out.  One
    pass counts the others and the markers of each chunk of ``CHUNK_LINES`` line
    numbers; the next one deals each line to the chunk in which its block begins
    (these small rows, one per chunk, are broadcast) and only then to tasks of
    about ``TASK_ROWS`` rows.  So lines shuffle once, without their recording's
    name, and more lines mean more tasks and not larger ones."""
    s = F.trim(F.col("line"))
    start, timed, used = s.startswith(BLOCK_START), s.contains("startTime"), s.contains("heapUsed")
    delta = F.length(F.replace(s, F.lit("}"), F.lit(""))) - F.length(F.replace(s, F.lit("{"), F.lit("")))
    t = F.when(timed, F.nullif(F.trim(F.regexp_extract(s, START_TIME_RE, 1)), F.lit("")))
    number, unit = (F.when(used, F.nullif(F.regexp_extract(s, HEAP_USED_RE, i), F.lit(""))) for i in (1, 2))
    lines = lines.filter(start | timed | used | s.contains("{") | s.contains("}")).withColumn("_lines", floor_div(line_no, CHUNK_LINES))
    # written, so that the ids of chunks are settled
    chunks = cut(lines.groupBy(key, "_lines").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(start).alias("_n"), F.min(F.when(start, F.col(line_no))).alias("_first"))
        .withColumn("_id", F.monotonically_increasing_id()), "heap_chunks")
    n_tasks = (chunks.agg(F.sum("_rows")).first()[0] or 0) // TASK_ROWS + 1
    w_key = Window.partitionBy(key)
    before = w_key.orderBy("_lines").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_open", F.last(F.when(F.col("_n") > 0, F.col("_id")), ignorenulls=True).over(before)) \
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_last_block", F.sum("_n").over(w_key))
    own = F.when(F.col(line_no) >= F.col("_first"), F.col("_id")).otherwise(F.col("_open"))
    b = lines.join(F.broadcast(chunks.select(key, "_lines", "_first", "_id", "_open")), [key, "_lines"]) \
        .select(own.alias("_own"), line_no, start.cast("long").alias("_start"), t.alias("_t"), number.alias("_number"), unit.alias("_unit"), delta.alias("_d")) \
        .filter(F.col("_own").isNotNull()).repartition(n_tasks, "_own")
    in_chunk = Window.partitionBy("_own").orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hv = F.col("_number").cast("double")
    mb = F.when(F.col("_unit") == "MB", hv).when(F.col("_unit") == "GB", hv * 1024).when(F.col("_unit") == "KB", hv / 1024) \
        .otherwise(hv / (1024 * 1024))
    b = b.select("_own", line_no, "_t", mb.alias("_mb"), "_d", F.sum("_start").over(in_chunk).alias("_nth"))
    w_blk = Window.partitionBy("_own", "_nth").orderBy(line_no)
    upto = w_blk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_depth", F.sum("_d").over(upto)) \
        .withColumn("_seen", F.max((F.col("_t").isNotNull() | F.col("_mb").isNotNull()).cast("int")).over(upto))
    closing = (F.col("_depth") == 0) & (F.col("_seen") == 1)
    b = b.withColumn("_end", F.min(F.when(closing, F.col(line_no))).over(Window.partitionBy("_own", "_nth")))
    inside = b.filter(F.col("_end").isNull() | (F.col(line_no) <= F.col("_end")))
    blk = inside.groupBy("_own", "_nth").agg(
        F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col(line_no))).alias("time_str"),
        F.max_by("_mb", F.when(F.col("_mb").isNotNull(), F.col(line_no))).alias("heap_mb"),
        F.max("_end").alias("_end"))
    blk = blk.join(F.broadcast(chunks.select(key, F.col("_id").alias("_own"), "_before", "_last_block")), "_own")
    number_in = F.col("_before") + F.col("_nth")
    keep = F.col("time_str").isNotNull() & F.col("heap_mb").isNotNull() & (F.col("_end").isNotNull() | (number_in < F.col("_last_block")))
    return blk.filter(keep).select(key, number_in.alias("sample_no"), "time_str", "heap_mb")


def _clock_seconds(t: Column) -> Column:
    h, m, s = (F.regexp_extract(t, CLOCK_RE, i).cast("int") for i in (1, 2, 3))
    frac = F.concat(F.lit("0."), F.regexp_extract(t, CLOCK_RE, 4)).cast("double")
    ok = t.rlike(CLOCK_RE) & (h < 24) & (m < 60) & (s <= 61)
    return F.when(ok, (h * 3600 + m * 60 + s).cast("double") + frac)


def _iso_seconds(t: Column) -> Column:
    g = [F.regexp_extract(t, ISO_RE, i).cast("int") for i in range(1, 7)]
    frac = F.concat(F.lit("0."), F.regexp_extract(t, ISO_RE, 7)).cast("double")
    ts = F.try_make_timestamp_ntz(g[0], g[1], g[2], g[3], g[4], g[5].cast("decimal(8,6)")) \
        if hasattr(F, "try_make_timestamp_ntz") else F.make_timestamp_ntz(g[0], g[1], g[2], g[3], g[4], g[5])
    secs = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.when(t.rlike(ISO_RE) & (g[5] <= 59), secs.cast("double") + frac)


def elapsed_seconds(samples: DataFrame, key: str = "recording", order: str = "sample_no") -> DataFrame:
    """H2: seconds since the first sample of each recording.

    The format is the one the first sample parses with (time of day, or ISO
    date-time); rows that do not parse with it are skipped; a day is added
    whenever the time goes backwards.  If the first sample parses with neither,
    every row gets its index instead."""
    t = F.col("time_str")
    s = samples.withColumn("_clock", _clock_seconds(t)).withColumn("_iso", _iso_seconds(t))
    first = s.groupBy(key).agg(F.min_by(F.struct("_clock", "_iso"), F.col(order)).alias("_f"))
    fmt = F.when(F.col("_f._clock").isNotNull(), F.lit("clock")) \
        .when(F.col("_f._iso").isNotNull(), F.lit("iso")).otherwise(F.lit("index"))
    first = first.select(key, fmt.alias("_fmt"), F.coalesce("_f._clock", "_f._iso").alias("_first_v"))
    s = s.join(first, key)
    chunk = floor_div(order, 100_000)      # consecutive sample numbers: bounded chunks
    out_cols = [c for c in samples.columns] + ["elapsed_s"]
    idx = sequence_features(s.filter(F.col("_fmt") == "index"), [key], [order], chunk, max_chunk_rows=None,
                            running={"_i": Running(F.lit(1).cast("long"), "sum")}) \
        .withColumn("elapsed_s", (F.col("_i") - 1).cast("double")).select(*out_cols)
    val = F.when(F.col("_fmt") == "clock", F.col("_clock")).otherwise(F.col("_iso"))
    p = s.filter(F.col("_fmt") != "index").withColumn("_v", val).filter(F.col("_v").isNotNull())
    # a day is added whenever the time goes backwards against the previous parsed row
    p = running_flag_count(p, [key], [order], chunk, ["_v"],
                           lambda prev, cur: prev.isNotNull() & (cur["_v"] < prev["_v"]), "_days",
                           max_chunk_rows=None)
    p = p.withColumn("elapsed_s", F.col("_v") - F.col("_first_v") + F.col("_days") * F.lit(float(DAY_S)))
    return idx.unionByName(p.select(*out_cols))


def growth(series: DataFrame, key: str = "recording", order: str = "sample_no") -> DataFrame:
    """H3: least-squares slope of MB over seconds, x60 (MB/min), and the first
    and last MB.  One point, or all at the same time: slope 0."""
    return series.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_samples"),
        (F.coalesce(F.regr_slope("heap_mb", "elapsed_s"), F.lit(0.0)) * 60).alias("growth_mb_per_min"),
        F.min_by("heap_mb", order).alias("initial_mb"),
        F.max_by("heap_mb", order).alias("final_mb"),
        F.max_by("elapsed_s", order).alias("last_s"),
    )


def assess(rate: Column) -> Column:
    """H4: leak class of a growth rate (MB/min)."""
    return F.when(rate > S.LEAK_MB_PER_MIN, F.lit("LEAK")) \
        .when(rate > S.POTENTIAL_LEAK_MB_PER_MIN, F.lit("POTENTIAL_LEAK")).otherwise(F.lit("STABLE"))


def recording_summary(series: DataFrame, key: str = "recording", order: str = "sample_no") -> DataFrame:
    """H5: duration (min, from the last sample), initial, final, growth, rate, class."""
    g = growth(series, key, order)
    return g.select(key, "n_samples", (F.col("last_s") / 60).alias("duration_min"), "initial_mb",
                    "final_mb", (F.col("final_mb") - F.col("initial_mb")).alias("growth_mb"),
                    "growth_mb_per_min", assess(F.col("growth_mb_per_min")).alias("assessment"))


def compare_runs(a: DataFrame, b: DataFrame, key: str = "recording") -> DataFrame:
    """H6: endpoint growth rate ((final - initial) / minutes) of two runs of the
    same recording key and the change in percent."""
    def rate(df, tag):
        r = (F.col("final_mb") - F.col("initial_mb")) / F.col("duration_min")
        return df.select(key, F.when(F.col("duration_min") > 0, r).alias(f"rate_{tag}"))
    j = rate(a, "a").join(rate(b, "b"), key, "inner")
    return j.withColumn("change_pct", F.when(F.col("rate_a") != 0,
                                             (F.col("rate_b") - F.col("rate_a")) / F.abs(F.col("rate_a")) * 100))
