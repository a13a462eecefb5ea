"""Places in a total order over all rows, without one task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import materialize


def ranked(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """rows plus name, the place from 1 in order. Rows are range-partitioned by it and numbered within partitions; the
    counts of the partitions before (one row a partition) are added. The partitioned rows are written once, as ranges are sampled."""
    dealt = rows.withColumn("_order", order).repartitionByRange("_order").withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as partitions
    first = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(W.partitionBy("_part").orderBy("_order"))
    return dealt.join(F.broadcast(first), "_part").withColumn(name, (F.col("_first") + within).cast("long")).drop("_order", "_part", "_first")
