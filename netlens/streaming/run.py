"""Running a stream to its end and reading what it gave."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.operators.scratch import scratch_path
from netlens.streaming.state import rocksdb


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can write."""
    return scratch_path(spark, "stream")


def event_time(ns: str = "start_ns"):
    return F.timestamp_micros(F.expr(f"`{ns}` div 1000"))  # a double would be some hundred nanoseconds off


class Numbered(NamedTuple):
    """A stream whose batches are numbered: number(batch, counts of the batches before it) gives a batch's rows and its counts (lane, n)."""

    stream: DataFrame
    number: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def run_available(stream: DataFrame | Numbered, mode: str = "append", stateful: bool = False) -> DataFrame:
    """All that the stream has now: the rows of every batch in append and update mode, those of the last one in complete mode.
    Each batch writes a folder of its own, so a batch that is repeated after a failure replaces itself. `stateful` streams keep their state in RocksDB."""
    step = None
    if isinstance(stream, Numbered):
        stream, step = stream
    spark = stream.sparkSession
    path = scratch(spark)
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        nonlocal schema
        if step:
            counts = f"{path}/counts"
            before = [f"{counts}/batch={n}" for n in range(number)]
            kind = "lane long, n long"
            batch, count = step(batch, spark.read.schema(kind).parquet(*before) if before else spark.createDataFrame([], kind))
            count.write.mode("overwrite").parquet(f"{counts}/batch={number}")
            schema = batch.schema
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    def start() -> None:
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()

    if stateful:
        with rocksdb(spark):
            start()
    else:
        start()
    out = spark.read.schema(schema.add("batch", "long")).parquet(f"{path}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == F.lit(last))
    return out.drop("batch")
