"""The sparse signal of an event stream, kept up to date as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Events as a stream of the files of that name in a folder, with the schema of the files there; times without a zone are taken for UTC."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    if schema["ts"].dataType == T.TimestampNTZType():
        events = events.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit(" UTC")).cast("timestamp"))
    return events


def cells(events: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, sample, experiment, x: the mean value per user, day and kind of event.

    Sums are combined in the partitions before they meet; days that end more than ``late``
    before the newest event are closed and leave the state in update and append mode.
    """
    day = F.window("ts", "1 day")
    kept = events.withWatermark("ts", late).groupBy("user_id", "event_type", day.alias("day")).agg(F.avg("value").alias("x"))
    experiment = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("day.start") / 86_400).cast("int")).cast("string")
    return kept.select("user_id", F.concat("event_type", F.lit("-"), experiment).alias("sample"), experiment.alias("experiment"), "x")


def run_to_end(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """What the stream holds once all that has arrived is worked off; its state and result lie in the shared ``folder``."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result-{number}")

    run = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/result-{max(p['batchId'] for p in run.recentProgress)}")
