"""Event streams as cubes: windowed sums with a watermark, and a sink that merges each batch into a store.

State is bounded by the watermark; late events beyond it are dropped, as Structured Streaming does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_totals(events: DataFrame, time: str, value: str, keys: Sequence[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums and counts by key and window of a (streaming or static) DataFrame: `keys..., time, value, n`."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    out = timed.groupBy(F.window(time, window), *keys).agg(F.sum(value).alias("value"), F.count(value).alias("n"))
    return out.select(*keys, F.to_date("window.start").alias("time"), "value", "n")


def stream_into(totals: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished windows to a Parquet folder, exactly once."""
    writer = totals.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def upsert_into(totals: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each batch's changed windows to a folder of its own, `batch=<number>`: a batch that is repeated after a failure
    replaces its folder, so every change is there once. `read_upserts` gives the windows as they stand, open ones too."""

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = totals.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_upserts(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Of each key and window the row of the last batch that changed it."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    last = Window.partitionBy(*keys, "time").orderBy(F.col("batch").desc())
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "batch")
