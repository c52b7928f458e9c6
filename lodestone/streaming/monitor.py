"""The monitor as a stream of snapshots. An extension: the polled queries are the batch form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.monitor import NOW, running
from ..sources.bank import Bank


def snapshots(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:  # noqa: ANN001
    """Activity snapshots that arrive as Parquet files under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def watch(activity: DataFrame, on_alert, over_s: float = 5, now: str = NOW):  # noqa: ANN001, ANN201
    """Calls on_alert(statements, batch id) for every batch that holds long statements."""

    def step(batch: DataFrame, n: int) -> None:
        long = running(batch, over_s, now)
        if not long.isEmpty():
            on_alert(long, n)

    return activity.writeStream.foreachBatch(step)


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events by type and window of ts; state older than the watermark is dropped."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "first_event")


def counted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tumbling_counts over the events table as a stream, run until its files are used up.

    Results go to Parquet files through foreachBatch, not to the driver.
    """
    table = Bank(spark, sf_dir).raw("events")
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="lodestone-")
    out = f"{base}/stream-{uuid.uuid4().hex}"
    # A table is one file here and a folder of files elsewhere: the glob fits both.
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    q = tumbling_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    q = q.foreachBatch(lambda d, n: d.write.mode("overwrite").parquet(f"{out}/result")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/result")
