"""Readers and sinks: exported records, event families, dimensions, text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions import names, scalars
from netlens.schemas import CONTAINER_SCHEMA, FAMILIES, JSON_RECORD_SCHEMA


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds of a timestamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) * F.lit(1000)


def parse_rfc3339(text: Column) -> Column:
    """Nanoseconds of 2024-01-01T00:00:07.179575Z."""
    whole = epoch_ns(F.try_to_timestamp(F.substring_index(F.rtrim(text, F.lit("Z")), ".", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 9, "0").cast("long")
    return whole + F.coalesce(fraction, F.lit(0))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Exported records (JSON lines) with start_ns and end_ns; fields that are missing are null."""
    rows = spark.read.schema(JSON_RECORD_SCHEMA).json(path)
    return rows.withColumns({"start_ns": parse_rfc3339(F.col("start_time")), "end_ns": parse_rfc3339(F.col("end_time"))})


def json_form(records: DataFrame) -> DataFrame:
    """Records in their exported form; columns that records lack are null."""
    have = set(records.columns)
    opt = lambda c, to: (F.col(c) if c in have else F.lit(None)).cast(to)
    ms = lambda c: scalars.ns_to_ms(opt(c, "double"))
    return records.select(
        scalars.rfc3339_nano(F.col("start_ns")).alias("start_time"), scalars.rfc3339_nano(F.col("end_ns")).alias("end_time"), names.protocol_name(F.col("protocol")).alias("protocol"), "side",
        "local_addr", "local_port", "remote_addr", "remote_port", "pid", "is_ssl", ms("total_ns").alias("total_duration_ms"), ms("black_box_ns").alias("black_box_duration_ms"),
        ms("read_socket_ns").alias("read_socket_duration_ms"), ms("copy_to_sock_ns").alias("copy_to_socket_buffer_duration_ms"), F.col("req_size").alias("req_size_bytes"), F.col("resp_size").alias("resp_size_bytes"),
        opt("req_plain_size", "long").alias("req_plain_text_size_bytes"), opt("resp_plain_size", "long").alias("resp_plain_text_size_bytes"), "request", "response",
        *[F.col(c) for c in ("req_syscall_events", "resp_syscall_events", "req_nic_events", "resp_nic_events") if c in have])


def write_records_json(records: DataFrame, path: str) -> None:
    """Append one JSON object for each record."""
    json_form(records).write.mode("append").json(path)


def stream_records_json(records: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Appends a stream's records as JSON objects, each exactly once: the sink's log and the checkpoint tell what is written, so a batch that is
    repeated after a restart adds nothing. read_records() of the path heeds that log. Returns the running query."""
    writer = json_form(records).writeStream.format("json").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def json_lines(records: DataFrame) -> DataFrame:
    """The exported form as text, one column `value`."""
    form = json_form(records)
    return form.select(F.to_json(F.struct(*form.columns)).alias("value"))


def read_events(spark: SparkSession, path: str, family: str, streaming: bool = False, kind: str = "parquet", **options: str) -> DataFrame:
    """Events of a family (conn, kern, syscall, ssl, first_packet, proc) from files of a kind (parquet, orc, json), as a table or a stream.
    options are the reader's: of streams maxFilesPerTrigger bounds a batch, and the checkpoint of the query remembers what was read."""
    if family not in FAMILIES:
        raise ValueError(f"no event family {family!r}; there are {', '.join(FAMILIES)}")
    reader = spark.readStream if streaming else spark.read
    return reader.schema(FAMILIES[family]).format(kind).options(**options).load(path)


def parsed_labels(containers: DataFrame) -> DataFrame:
    """Labels from JSON text to a map."""
    return containers.withColumn("labels", F.from_json("labels", "map<string,string>"))


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    return parsed_labels(spark.read.schema(CONTAINER_SCHEMA).parquet(path))


def format_records(records: DataFrame, request: bool = True, response: bool = True, timings: bool = True, limit: int = 1024) -> DataFrame:
    """One readable block for each record, column `value`; options choose its sections, texts are cut to `limit` bytes."""
    side, c = F.col("side"), F.col
    head = F.concat(scalars.connection_label(c("local_addr"), c("local_port"), c("remote_addr"), c("remote_port"), side), F.lit(" "), names.protocol_name(c("protocol")), F.lit(" pid="), c("pid").cast("string"))
    parts = [head]
    if request:
        parts.append(F.concat(F.lit("[ Request ]\n"), scalars.truncated(F.coalesce("request", F.lit("")), limit)))
    if response:
        parts.append(F.concat(F.lit("[ Response ]\n"), scalars.truncated(F.coalesce("response", F.lit("")), limit)))
    if timings:
        ms = lambda x: scalars.displayed(scalars.ns_to_ms(c(x)))
        parts.append(F.concat(F.lit("[ total ] = "), ms("total_ns"), F.lit("ms [ "), names.black_box_name(side), F.lit(" ] = "), ms("black_box_ns"), F.lit("ms [ "), names.syscall_name(side, F.lit(False)), F.lit(" ] = "), ms("read_socket_ns"), F.lit("ms")))
    return records.select(F.concat_ws("\n", *parts).alias("value"))


def write_records_text(records: DataFrame, path: str, **options) -> None:
    format_records(records, **options).write.mode("append").text(path)


def for_each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Calls fn with each micro-batch and its number; returns the running query. After a restart the last batch may come again, with its
    number: what fn writes by number is written once."""
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
