"""Cutting the lineage of loops."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that kept() wrote; they go when the process ends.
_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, if the session names one: spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named.rstrip("/") if named else None


def kept(df: DataFrame) -> DataFrame:
    """df computed once: written in the shared folder and read back, or in memory where none is set.

    What follows reads files that every executor sees, so a loop's plan doesn't grow and a lost
    executor costs only its own tasks.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return df.persist()
    path = f"{folder}/weft/step-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for path, spark in _WRITTEN.items():
        if spark.sparkContext._jsc is not None:  # the session still runs
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
