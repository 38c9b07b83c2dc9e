"""The tracker as a stream: repeated requests dropped within a watermark, windowed service levels,
and micro-batches appended by anti-join."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import shared_dir


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def first_requests(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def run_to_table(frame: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is and return the result as a table in the shared folder."""
    spark = frame.sparkSession
    home = f"{shared_dir(spark)}/concord/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    frame.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.parquet(f"{home}/out")


def append_batches(events: DataFrame, folder: str) -> None:
    """Append each micro-batch's new ids to a Parquet tracker: an anti-join a batch, a batch written once."""

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["event_id"])
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.parquet(folder).where(F.col("batch") != number)
            fresh = fresh.join(held.select("event_id"), "event_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    events.writeStream.option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def stream_first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct events of the stream by type."""
    return run_to_table(first_requests(read_events(spark, sf_dir)), "append").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type, from the complete windowed aggregate."""
    done = run_to_table(windowed(read_events(spark, sf_dir)), "complete")
    last = done.agg(F.max("batch")).first()[0]
    return done.where(F.col("batch") == last).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


ORACLES = {
    "stream_first_requests": "select event_type, count(distinct event_id) as n, count(distinct event_id) as ids from events group by 1",
    "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
}
QUERIES = {f.__name__: f for f in (stream_first_requests, stream_windows)}
