"""Statistics over streams of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import histogram
from netlens.operators import rollups, stats
from netlens.streaming.run import event_time

c = F.col

#: How long records may come late before they are dropped.
SETTLE = "1 second"


def settled(records: DataFrame, delay: str = SETTLE) -> DataFrame:
    """records with event_time and a watermark: later stages wait so long for what comes late, and then let go of their state."""
    return records.withColumn("event_time", event_time()).withWatermark("event_time", delay)


def cumulative(records: DataFrame, group_by: str = "conn", metric: str = "total-time") -> DataFrame:
    """The statistics of all records so far; write it in complete mode, with a trigger for the refresh."""
    return stats.stat(records, group_by, metric)


def windowed(records: DataFrame, seconds: int, group_by: str = "conn", metric: str = "total-time", delay: str = SETTLE) -> DataFrame:
    """The statistics of each window of `seconds`, once it is over; state is let go with it."""
    rows = stats._base(settled(records, delay), metric).withColumn("class_id", stats.CLASSIFIERS[group_by]())
    out = rows.groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), "class_id").agg(*stats.aggregates())
    return histogram.cumulated(out).select(F.unix_micros("w.start").alias("window_us"), "class_id", *stats.measures(metric in stats.SIZES))


def windowed_states(records: DataFrame, seconds: int, group_by: str = "conn", metric: str = "total-time", delay: str = SETTLE) -> DataFrame:
    """rollups.states() of each window of `seconds`, once it is over; rollups.merged() makes hours and days of them."""
    rows = stats._base(settled(records, delay), metric).withColumn("class_id", stats.CLASSIFIERS[group_by]())
    out = rows.groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), "class_id").agg(*rollups.state_columns())
    return out.select(F.unix_micros("w.start").alias("window_us"), *[k for k in out.columns if k != "w"])


def deduplicated(events: DataFrame, keys: list[str], delay: str = SETTLE) -> DataFrame:
    """Events that have not been seen within the watermark. events has event_time."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys)


def merge_top(known: DataFrame | None, batch: DataFrame, k: int) -> DataFrame:
    """The k greatest of each class from what is known and a new batch; both have class_id, value, start_ns, record_id."""
    rows = batch if known is None else known.unionByName(batch)
    order = Window.partitionBy("class_id").orderBy(c("value").desc(), "start_ns", "record_id")
    return rows.dropDuplicates(["class_id", "record_id"]).withColumn("_n", F.row_number().over(order)).where(c("_n") <= k).drop("_n")


def keep_top(samples: DataFrame, path: str, checkpoint: str, k: int = 10):
    """Keeps the top samples of a stream (class_id, value, start_ns, record_id) as a table: each batch writes the next version,
    path/v=N, from the last one; versions before that one go. Returns the stream writer; the caller sets the trigger and starts it."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}") if number else None
        merge_top(known, batch, k).write.mode("overwrite").parquet(f"{path}/v={number}")
        if number > 1:  # a batch that is repeated reads the version before its own
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return samples.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
