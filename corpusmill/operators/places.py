"""Places of rows in an order, over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.lineage import cut


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """rows with their places from 1 in the order that they have, which a sort over all of them gave.

    The sorted rows are written once, for a partition computed again might hold others. A row's place is its place in its partition and the rows of the partitions before; only these counts, one for each
    partition, meet in one task and are broadcast. No rows give none.
    """
    at, bits = F.monotonically_increasing_id(), 33  # the partition above 33 bits of the place in it
    kept = cut(rows).select(F.struct(*rows.columns).alias("row"), at.alias("_at")).withColumn("_part", F.shiftright("_at", bits))
    sizes = kept.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.col("_at") - F.shiftleft("_part", bits)
    return kept.join(F.broadcast(before), "_part").select("row.*", (within + F.col("_before") + 1).alias(name))
