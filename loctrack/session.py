"""Session helpers.

Everything in this library is epoch milliseconds in UTC, so the session time zone
is pinned to UTC before any date text is produced or parsed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "loctrack", extra: dict | None = None) -> SparkSession:
    """A session with the library's settings.  Master and shuffle partitions are
    the cluster's, unless they are passed."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    use_utc(spark)
    return spark


def use_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") not in _UTC_NAMES:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, streaming state and intermediate tables.

    It is what ``spark.checkpoint.dir`` names, a folder that all executors share.
    Where nothing is configured, a new temporary folder is taken in local mode
    only, in which driver and executors are one process; a cluster must name one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="loctrack-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the checkpoint folder and read it back.

    Lineage ends there: what follows may use the table several times without
    computing it again, its plan stays small, and a lost executor costs only
    tasks of what follows.  The folder is the caller's to clean, like
    checkpoints are."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cut/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
