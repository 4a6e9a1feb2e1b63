"""Votes as a stream: running counts for each pair, and volumes by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream; new files are taken up as they come."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def running_votes(stream: DataFrame) -> DataFrame:
    """Positive and negative votes for each pair; the state is two counts for a pair."""
    return stream.groupBy("src_id", "tgt_id").agg(F.count_if(F.col("is_correct")).alias("pos"), F.count_if(~F.col("is_correct")).alias("neg"))


def volume(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events for each type and window; windows close when the watermark has passed them."""
    timed = stream.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """Take up all that is there now, then stop. Complete results replace the folder, others are added to it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
