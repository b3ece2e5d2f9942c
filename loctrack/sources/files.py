"""Metric CSV files of the load tools, heap recording text, service logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loctrack import schemas as S
from loctrack.functions import join_ids, ms_text, rfc3339_text, split_ids


def _read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    # A row with a wrong column count is fatal, as in the load tool's reader.
    return (spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST")
            .option("escape", '"').csv(path))


def _ts_ms(c: str = "timestamp") -> Column:
    return F.unix_millis(F.to_timestamp(F.col(c)))


def read_publish_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp,event_id,skater_id,response_time_ms,error`` -> typed rows
    with ``ts_ms`` (RFC 3339 text carries its offset) and '' for no error."""
    df = _read_csv(spark, path, S.PUBLISH_METRICS)
    return df.withColumn("ts_ms", _ts_ms()).withColumn("error", F.coalesce("error", F.lit(""))) \
        .withColumn("source_file", F.input_file_name())


def read_delivery_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Delivery CSV with the '|'-joined ids as an array (empty text -> empty list)."""
    df = _read_csv(spark, path, S.DELIVERY_METRICS)
    return (df.withColumn("ts_ms", _ts_ms()).withColumn("error", F.coalesce("error", F.lit("")))
              .withColumn("skater_ids", F.coalesce("skater_ids", F.lit("")))
              .withColumn("skater_id_list", split_ids("skater_ids", "|"))
              .withColumn("source_file", F.input_file_name()))


def publish_metrics_text(df: DataFrame) -> DataFrame:
    """The publish CSV columns as text: RFC 3339 time, ms with two decimals
    (from integer microseconds when ``response_time_us`` is given), '' when ok."""
    rt = (F.col("response_time_us") / F.lit(1000.0)) if "response_time_us" in df.columns \
        else F.col("response_time_ms")
    return df.select(rfc3339_text("ts_ms").alias("timestamp"), F.col("event_id"),
                     F.col("skater_id"), ms_text(rt).alias("response_time_ms"),
                     F.coalesce(F.col("error"), F.lit("")).alias("error"))


def delivery_metrics_text(df: DataFrame) -> DataFrame:
    """The delivery CSV columns as text (ids joined by '|')."""
    ids = join_ids(F.col("skater_id_list")) if "skater_id_list" in df.columns else F.col("skater_ids")
    return df.select(rfc3339_text("ts_ms").alias("timestamp"), F.col("event_id"),
                     F.col("viewer_number").cast("string").alias("viewer_number"),
                     F.col("message_count").cast("string").alias("message_count"),
                     ms_text("latency_ms").alias("latency_ms"), ids.alias("skater_ids"),
                     F.coalesce(F.col("error"), F.lit("")).alias("error"))


def _write_csv(df: DataFrame, path: str, mode: str) -> None:
    (df.write.mode(mode).option("header", "true").option("escape", '"').option("quoteAll", "false")
       .option("emptyValue", "").csv(path))


def write_publish_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _write_csv(publish_metrics_text(df), path, mode)


def write_delivery_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _write_csv(delivery_metrics_text(df), path, mode)


def _numbered_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, line_no, line) of text files, numbered from 0 within each file.

    Files are read in splits; a scan deals a split's lines consecutive row ids, so
    a line's place in its split is its id less the split's first id.  The lines of
    a file's earlier splits are added from a count of each split (one row per
    split, broadcast).  Both scans read the same listing in the same splits.
    Lines are neither sorted nor dealt out anew, so a task holds none of them."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias(source), F.col("_metadata.file_block_start").alias("_at"),
                                     F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    earlier = Window.partitionBy(source).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    per = t.groupBy(source, "_at").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .select(source, "_at", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return t.join(F.broadcast(per), [source, "_at"]) \
        .select(source, (F.col("_row") + F.col("_shift")).cast("long").alias("line_no"), "line")


def read_heap_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recording text files -> (recording, line_no, line); a file is a recording."""
    return _numbered_lines(spark, path, "recording")


def read_app_logs(spark: SparkSession, path: str) -> DataFrame:
    """A10: service log files -> (source_file, line_no, line), then parsed."""
    from loctrack.operators.logs import parse_log_lines
    return parse_log_lines(_numbered_lines(spark, path, "source_file"))
