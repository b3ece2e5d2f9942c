"""I1-I3 and the log-line parser: crash scan, sweep results, per-event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loctrack import schemas as S
from loctrack.functions import epoch_ms_ntz

# The service log layout "date time LEVEL logger [source] message"
# and the message texts of the sweeps and request handlers.
ANSI_RE = r"\x1b\[[0-9;]*m"
LINE_RE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) +([A-Z]+) +(\S+) +(.*)$"
EXIT_CODE_RE = r"exit code ([0-9]+)"
SWEEP_LOCATIONS_RE = r"Cleanup completed: removed (\d+) locations"
SWEEP_HUBS_RE = r"Hub cleanup completed: removed (\d+) hubs"
SWEEP_LOCATIONS_FAILED = "Cleanup failed: "
SWEEP_HUBS_FAILED = "Hub cleanup failed: "
REQUEST_RE = r"Received location update request for event=([^,\s]*), skater=(\S*)"
CONNECT_RE = r"WebSocket connection established for event=(\S*)"
REJECT_RE = r"Validation failed: (\S+) - (.*)$"
STREAM_ERROR_RE = r"Stream error for event=([^:\s]*): (.*)$"


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Split raw lines (``line_no``, ``line``) into time text, epoch ms, level,
    logger and message.  ANSI colour codes are removed first; a line that does
    not match the layout is kept whole as the message."""
    clean = F.regexp_replace("line", ANSI_RE, "")
    m = clean.rlike(LINE_RE)
    ts_text = F.when(m, F.regexp_extract(clean, LINE_RE, 1))
    return lines.select(
        "line_no", *[c for c in lines.columns if c not in ("line_no", "line")],
        ts_text.alias("time_text"),
        epoch_ms_ntz(F.to_timestamp_ntz(ts_text, F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts_ms"),
        F.when(m, F.regexp_extract(clean, LINE_RE, 2)).alias("level"),
        F.when(m, F.regexp_extract(clean, LINE_RE, 3)).alias("logger"),
        F.when(m, F.regexp_extract(clean, LINE_RE, 4)).otherwise(clean).alias("message"),
        clean.alias("text"))


def crash_scan(logs: DataFrame, tail: int | None = None) -> DataFrame:
    """Lines that show a crash: an indicator word, or ``exit code N`` with
    N != "0".  ``tail`` limits the scan to the last lines of each log (top-N by
    line number per ``source_file``, the only place a limit is the feature)."""
    src = logs
    if tail is not None:
        # a rank filter: each task forwards at most ``tail`` lines of a log
        log = [F.col("source_file")] if "source_file" in logs.columns else []
        w = Window.partitionBy(*log).orderBy(F.col("line_no").desc())
        src = logs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= tail).drop("_rn") if log \
            else logs.orderBy(F.col("line_no").desc()).limit(tail)
    txt = F.col("text") if "text" in src.columns else F.col("line")
    hit = F.lit(None).cast("string")
    for word in reversed(S.CRASH_INDICATORS):
        hit = F.when(txt.contains(word), F.lit(word)).otherwise(hit)
    codes = F.regexp_extract_all(txt, F.lit(EXIT_CODE_RE), 1)
    bad_code = F.filter(codes, lambda c: c != "0")
    reason = F.coalesce(hit, F.when(F.size(bad_code) > 0,
                                    F.concat(F.lit("exit code "), F.element_at(bad_code, 1))))
    return src.withColumn("crash_reason", reason).filter(F.col("crash_reason").isNotNull())


def sweep_log(logs: DataFrame) -> DataFrame:
    """One row per sweep line: kind (locations / hubs), removed count, or a failure."""
    msg = F.col("message")
    kind = F.when(msg.rlike(SWEEP_HUBS_RE) | msg.startswith(SWEEP_HUBS_FAILED), F.lit("hubs")) \
        .when(msg.rlike(SWEEP_LOCATIONS_RE) | msg.startswith(SWEEP_LOCATIONS_FAILED), F.lit("locations"))
    n = F.when(msg.rlike(SWEEP_HUBS_RE), F.regexp_extract(msg, SWEEP_HUBS_RE, 1).cast("long")) \
        .when(msg.rlike(SWEEP_LOCATIONS_RE), F.regexp_extract(msg, SWEEP_LOCATIONS_RE, 1).cast("long"))
    failed = msg.startswith(SWEEP_HUBS_FAILED) | msg.startswith(SWEEP_LOCATIONS_FAILED)
    return logs.select("line_no", "ts_ms", kind.alias("kind"), n.alias("n_removed"), failed.alias("failed")) \
        .filter(F.col("kind").isNotNull())


def sweep_totals(sweeps: DataFrame, period_ms: int = 3_600_000) -> DataFrame:
    """Removed totals and failures per kind and period."""
    p = (F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(period_ms)))
    return sweeps.groupBy("kind", p.alias("period_ms")).agg(
        F.count(F.lit(1)).alias("n_sweeps"),
        F.coalesce(F.sum("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.count_if("failed").alias("n_failed"))


def event_lines(logs: DataFrame) -> DataFrame:
    """Request, connect, reject and stream-error lines with the event and
    entity they name (reject lines carry no ids in the text)."""
    msg = F.col("message")
    kind = F.when(msg.rlike(REQUEST_RE), F.lit("request")).when(msg.rlike(CONNECT_RE), F.lit("connect")) \
        .when(msg.rlike(REJECT_RE), F.lit("reject")).when(msg.rlike(STREAM_ERROR_RE), F.lit("stream_error"))
    ev = F.when(msg.rlike(REQUEST_RE), F.regexp_extract(msg, REQUEST_RE, 1)) \
        .when(msg.rlike(CONNECT_RE), F.regexp_extract(msg, CONNECT_RE, 1)) \
        .when(msg.rlike(STREAM_ERROR_RE), F.regexp_extract(msg, STREAM_ERROR_RE, 1))
    ent = F.when(msg.rlike(REQUEST_RE), F.regexp_extract(msg, REQUEST_RE, 2))
    code = F.when(msg.rlike(REJECT_RE), F.regexp_extract(msg, REJECT_RE, 1))
    return logs.select("line_no", "ts_ms", kind.alias("kind"), ev.alias("event_id"), ent.alias("entity_id"),
                       code.alias("error_code")).filter(F.col("kind").isNotNull())


def logs_for_event(logs: DataFrame, ids) -> DataFrame:
    """The lines of the given events (list, comma text, or id DataFrame)."""
    from loctrack.operators.validate import for_events
    return for_events(event_lines(logs), ids)
