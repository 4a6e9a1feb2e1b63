"""Places in an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.cut import kept


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with each row's place in the order, from 0.

    The sorted rows are cut into ranges and kept (in the shared folder, or in memory
    where none is set); each range is numbered by itself, and the ranges' sizes, one for each
    partition, are what the driver adds up.
    """
    spark = df.sparkSession
    parts = df.orderBy(*order).withColumn("_p", F.spark_partition_id())
    parts = kept(parts)
    sizes, before = [], 0
    for row in sorted(parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()):
        sizes.append((row._p, before))
        before += row.n
    offsets = spark.createDataFrame(sizes, "_p int, _before long")
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")
