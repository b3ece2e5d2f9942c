"""A total order over a whole table, dealt over all tasks.

Rows go to range partitions of the order, each is sorted on its own and written;
a place is the rows of all earlier partitions and the place inside one.  Only
one row for each partition meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loctrack.llm.common import written

_PART = 33


def ranked(df: DataFrame, order: list[Column], place: str) -> DataFrame:
    """``df`` with ``place``: 0, 1, 2... along ``order``, which should be total:
    rows equal in all of it stay in one partition and get any order."""
    at = "_at"
    while at in df.columns:
        at += "_"
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, _PART)
    per = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(F.col("part").alias(f"{at}part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(f"{at}before"))
    placed = rows.withColumn(f"{at}part", part).join(F.broadcast(before), f"{at}part")  # one row for each partition
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(f"{at}before") + F.col(at).bitwiseAND(F.lit((1 << _PART) - 1))).alias(place))
