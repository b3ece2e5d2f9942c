"""Stored forms of the keyed state: a snapshot that is kept up to date without
rereading history (C2), tables bucketed by event (B7, C5, D1), and an interval
index that answers many reader times at once (C5).

Everything is parquet under a folder that all executors share; nothing is held
by the driver but one small manifest.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loctrack.functions import floor_div
from loctrack.operators import state as C
from loctrack.session import checkpoint_dir, cut


# ------------------------------------------------------------------------- C2, stored
class StoredSnapshot:
    """The latest row of each (event, entity), in cells by hash of the event and,
    inside, of the entity.

    An upsert reads and rewrites only the cells that its batch touches.  New files
    never replace old ones: a manifest, one small file with a number, names the
    folder of every cell.  It is written after all data, under the next number,
    and only if no one else has written that number; so a reader sees the state
    before or after a batch, a job that fails leaves the state before, and of two
    writers one gets an error (by a rename that does not replace, which HDFS has).  A batch with an id that the manifest already holds
    (a replay after a restart) changes nothing.

    ``cells`` spreads events, ``spread`` spreads the entities of one event, so
    that a hot event's rows are ``spread`` cells; a reader of one event opens
    ``spread`` of the ``cells * spread`` cells."""

    def __init__(self, spark: SparkSession, path: str, cells: int = 64, spread: int = 8) -> None:
        self.spark, self.path, self.cells, self.spread = spark, path.rstrip("/"), cells, spread
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        self._fs, self._hadoop = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    # -- manifest
    def _last(self) -> int:
        folder = self._hadoop(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return -1
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()), default=-1)

    def manifest(self, number: int | None = None) -> dict:
        """{"number", "cells": {cell: folder}, "batch": its id, "schema": JSON or null},
        the last one or that of a number."""
        n = self._last() if number is None else number
        if n < 0:
            return {"number": -1, "cells": {}, "batch": None, "schema": None}
        stream = self._fs.open(self._hadoop(f"{self.path}/manifest/{n:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """Publish under the manifest's number, which nobody may have taken."""
        data = json.dumps(manifest).encode()
        hidden = self._hadoop(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        try:
            out.write(data)
        finally:
            out.close()
        target = self._hadoop(f"{self.path}/manifest/{manifest['number']:012d}")
        if self._fs.exists(target) or not self._fs.rename(hidden, target):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"another writer has published {target}")

    # -- data
    def _cell(self, entity: Column | None = None) -> Column:
        home = F.pmod(F.xxhash64("event_id"), F.lit(self.cells)) * self.spread
        return (home + F.pmod(F.xxhash64(F.coalesce(F.col("entity_id"), F.lit("")), F.lit(1)), F.lit(self.spread))).cast("int") if entity is None else (home + entity).cast("int")

    def _rows(self, manifest: dict, cells: list[int] | None = None) -> DataFrame | None:
        folders = [f for c, f in manifest["cells"].items() if cells is None or int(c) in cells]
        if not folders:
            return None
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in sorted(folders)))

    def read(self, events: list[str] | None = None) -> DataFrame | None:
        """The rows now, of all events or of some, of which only the cells are opened."""
        manifest = self.manifest()
        if events is None:
            return self._rows(manifest)
        given = self.spark.createDataFrame([(e,) for e in events], "event_id string").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(self.spread - 1)), self._cell)).alias("cell"))
        found = self._rows(manifest, [r.cell for r in given.distinct().collect()])
        return found if found is None else found.filter(F.col("event_id").isin(events))

    def upsert(self, updates: DataFrame, batch_id: int | str | None = None) -> int:
        """Apply a batch; the number of cells that were rewritten."""
        manifest = self.manifest()
        if batch_id is not None and manifest["batch"] == batch_id:
            return 0
        batch = cut(C.latest_locations(updates).withColumn("_cell", self._cell()), "upsert")
        touched = [r[0] for r in batch.select("_cell").distinct().collect()]  # at most cells * spread numbers
        schema = batch.drop("_cell").schema
        if manifest["schema"] not in (None, schema.json()):
            raise ValueError("a batch must have the columns of the snapshot")
        old = self._rows(manifest, touched)
        rows = batch.drop("_cell")
        now = C.upsert(old, rows) if old is not None else rows
        folder = f"data/{uuid.uuid4().hex}"
        cell = self._cell()
        # a cell's rows to few tasks, a very full cell's to more: AQE splits and merges them
        now.withColumn("_cell", cell).hint("rebalance", "_cell").sortWithinPartitions("_cell", "event_id", "entity_id").write.partitionBy("_cell").parquet(f"{self.path}/{folder}")
        self._commit({"number": manifest["number"] + 1, "batch": batch_id, "schema": schema.json(),
                      "cells": manifest["cells"] | {str(c): f"{folder}/_cell={c}" for c in touched}})
        return len(touched)

    def clean(self, keep: int = 2, older_ms: int = 3_600_000) -> int:
        """Delete cells that none of the last ``keep`` manifests names, and of failed
        batches; the number deleted.  Folders written within ``older_ms`` stay, as a
        batch may be on its way and a reader may still hold the manifest before."""
        last = self._last()
        named = {f for n in range(max(0, last - keep + 1), last + 1) for f in self.manifest(n)["cells"].values()}
        now, gone = time.time() * 1000, 0
        data = self._hadoop(f"{self.path}/data")
        for batch in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if now - batch.getModificationTime() < older_ms:
                continue
            cells = [c for c in self._fs.listStatus(batch.getPath()) if c.isDirectory()]
            kept = [c for c in cells if f"data/{batch.getPath().getName()}/{c.getPath().getName()}" in named]
            for c in [c.getPath() for c in cells if c not in kept] if kept else [batch.getPath()]:
                gone += bool(self._fs.delete(c, True))
        return gone


# ------------------------------------------------------------------------- bucketed tables
def write_bucketed(df: DataFrame, name: str, buckets: int, by: str = "event_id", sort: list[str] = (), path: str | None = None) -> DataFrame:
    """``df`` as a table of the session's catalog, bucketed by ``by``: filters on
    ``by`` open only the buckets that they need, and two tables with the same
    number of buckets join on it without an exchange."""
    path = path or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/bucketed/{name}-{uuid.uuid4().hex[:12]}"
    w = df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).option("path", path)
    (w.sortBy(by, *sort) if sort else w.sortBy(by)).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def slotted(df: DataFrame, slots: int, spread: list[str] | None = None) -> DataFrame:
    """``df`` with ``slot``, "event#k": with ``spread``, each row in the slot that
    these columns hash to, else once in every slot.  Tables bucketed by slot join
    without an exchange, and a hot event is ``slots`` buckets."""
    k = F.pmod(F.xxhash64(*spread), F.lit(slots)) if spread else F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    return df.withColumn("_k", k).withColumn("slot", F.concat("event_id", F.lit("#"), F.col("_k").cast("string"))).drop("_k")


def events_of(table: DataFrame, events: list[str], slots: int | None = None) -> DataFrame:
    """B7 on a bucketed table: the rows of some events, from their buckets alone."""
    if slots is None:
        return table.filter(F.col("event_id").isin(events))
    return table.filter(F.col("slot").isin([f"{e}#{k}" for e in events for k in range(slots)]))


def fan_out_bucketed(updates: DataFrame, viewers: DataFrame) -> DataFrame:
    """D1 on two tables bucketed by slot: no exchange.  A slot names its event, so
    it is the only key of the join."""
    u, v = updates.alias("u"), viewers.alias("v")
    live = (F.col("u.slot") == F.col("v.slot")) & (F.col("ts_ms") > F.col("subscribed_ms")) & (F.col("left_ms").isNull() | (F.col("ts_ms") <= F.col("left_ms")))
    return u.hint("merge").join(v, live).select("viewer_id", *(F.col(f"u.{c}") for c in ("event_id", "entity_id", "longitude", "latitude", "ts_ms", "seq")), "subscribed_ms")


# ------------------------------------------------------------------------- C5, many times
class IntervalIndex:
    """Versions as intervals [ts, end), each dealt to the dyadic time blocks of
    the level that its length calls for: blocks no shorter than the interval, so
    it lies in two of them at most.  A time is in one block of each level; a query
    for many times touches, per time, one block of each level that exists, not
    the history.  The exact borders are a post-filter; a block is at most twice as
    long as its intervals, so the filter keeps a fixed share.

    Versions of one block are spread over ``spread`` keys by entity, and times,
    which are few, stand in all of them."""

    LEVELS = 48

    def __init__(self, rows: DataFrame, spread: int) -> None:
        self.rows, self.spread = rows, spread
        # one number for each level that exists, 48 at most
        self.levels = sorted(r[0] for r in rows.select("level").distinct().collect())

    @classmethod
    def build(cls, updates: DataFrame, ttl_ms: int, sweep_ms: int, origin_ms: int = 0, chunk_ms: int = 86_400_000, spread: int = 8) -> IntervalIndex:
        """From the update history; written once, sorted by block, so that later
        queries skip row groups."""
        v = C.versions(updates, ttl_ms, sweep_ms, origin_ms, chunk_ms).filter(F.col("end_ms") > F.col("ts_ms"))
        length = F.col("end_ms") - F.col("ts_ms")
        level = F.length(F.bin(length - 1)).cast("int")  # least l with 2^l >= length
        level = F.when(length <= 1, F.lit(0)).otherwise(level)
        first, last = (F.expr(f"shiftright({c}, level)") for c in ("ts_ms", "end_ms - 1"))
        rows = v.withColumn("level", level).withColumn("block", F.explode(F.array_distinct(F.array(first, last)))) \
            .withColumn("part", F.pmod(F.xxhash64("entity_id"), F.lit(spread)).cast("int"))
        cols = [*C.KEY, "longitude", "latitude", "ts_ms", "seq", "end_ms", "level", "block", "part"]
        return cls(cut(rows.select(*cols).repartitionByRange("level", "block", "part").sortWithinPartitions("level", "block", "part"), "intervals"), spread)

    def at(self, times: DataFrame, col: str = "at_ms") -> DataFrame:
        """C5 at every time of ``times`` (at_ms): the visible rows with their time."""
        t = times.select(F.col(col).cast("long").alias("at_ms")).distinct()
        levels = F.array(*(F.lit(n) for n in self.levels)) if self.levels else F.array().cast("array<int>")
        q = t.withColumn("level", F.explode(levels)).withColumn("block", F.expr("shiftright(at_ms, level)")) \
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.spread - 1))))
        hit = self.rows.join(q, ["level", "block", "part"])
        return hit.filter((F.col("ts_ms") <= F.col("at_ms")) & (F.col("at_ms") < F.col("end_ms"))) \
            .select("at_ms", *C.KEY, "longitude", "latitude", "ts_ms", "seq")


def busiest_block(index: IntervalIndex) -> DataFrame:
    """(level, block, n): how full the blocks are, for choosing ``spread``."""
    return index.rows.groupBy("level", "block").agg(F.count(F.lit(1)).alias("n"))


def reader_times(from_ms: int, to_ms: int, n: int, spark: SparkSession) -> DataFrame:
    """``n`` times, evenly spaced from ``from_ms`` on."""
    return spark.range(n).select((F.lit(from_ms) + floor_div(F.col("id") * F.lit(to_ms - from_ms), n)).alias("at_ms"))
