"""Places of rows in an order of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.sources.scratch import stored

#: monotonically_increasing_id counts within a partition in this many bits.
_BITS = 33


def with_position(rows: DataFrame, *order: str, name: str = "position", partitions: int | None = None) -> DataFrame:
    """rows with their place in the order, counted from 0 without gaps, however they are partitioned later.

    Tasks sort ranges of the order; each knows its rows' places once the ranges before it are
    counted. Only those counts meet, one for each partition. The sorted table is written, so that
    places don't change when a task is run again. Ties keep one order or another.
    """
    parts = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    at = stored(parts.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", _BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return at.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + inside).alias(name))
