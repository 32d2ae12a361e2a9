"""Decoded message bodies as rows: Kafka topics, partitions and records, DNS questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import scalars

c = F.col

_MESSAGES = "struct<size:bigint,record_batches:array<struct<records:array<struct<key:string,value:string>>>>>"
#: Decoded bodies; a part that a message does not have is null.
PRODUCE_REQUEST = f"struct<transactional_id:string,acks:smallint,timeout_ms:int,topics:array<struct<name:string,partitions:array<struct<index:int,message_set:{_MESSAGES}>>>>>"
PRODUCE_RESPONSE = "struct<topics:array<struct<name:string,partitions:array<struct<index:int,error_code:smallint,base_offset:bigint,log_append_time_ms:bigint,log_start_offset:bigint,record_errors:array<struct<batch_index:int,error_message:string>>,error_message:string>>>>,throttle_time_ms:int>"
FETCH_RESPONSE = f"struct<throttle_time_ms:int,error_code:smallint,session_id:int,topics:array<struct<name:string,partitions:array<struct<index:int,error_code:smallint,high_watermark:bigint,last_stable_offset:bigint,log_start_offset:bigint,preferred_read_replica:int,message_set:{_MESSAGES}>>>>>"


def partitions(rows: DataFrame, body: str = "body", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """A row for each topic and partition of produce and fetch bodies: keep, topic, and the fields of the partition."""
    topics = rows.select(*keep, F.explode(f"{body}.topics").alias("t"))
    return topics.select(*keep, c("t.name").alias("topic"), F.explode("t.partitions").alias("p")).select(*keep, "topic", "p.*")


def records(rows: DataFrame, body: str = "body", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """A row for each record of produce requests and fetch responses: keep, topic, index, batch and place in it, key, value."""
    batches = partitions(rows, body, keep).select(*keep, "topic", "index", F.posexplode("message_set.record_batches").alias("batch", "b"))
    return batches.select(*keep, "topic", "index", "batch", F.posexplode("b.records").alias("place", "r")).select(*keep, "topic", "index", "batch", "place", "r.key", "r.value")


def dns_records(rows: DataFrame, questions: str = "questions", answers: str = "answers", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """A row for each question and then each answer: keep, place, name, type, type_name, cname. Questions are struct<name, type>, answers
    struct<name, type, value, text>: an address stands for itself, any other answer for its whole text."""
    asked = F.transform(F.coalesce(questions, F.array().cast("array<struct<name:string,type:int>>")), lambda q: F.struct(q["name"].alias("name"), q["type"].cast("int").alias("type"), F.lit(None).cast("string").alias("cname")))
    told = F.transform(F.coalesce(answers, F.array().cast("array<struct<name:string,type:int,value:string,text:string>>")), lambda a: F.struct(a["name"].alias("name"), a["type"].cast("int").alias("type"), F.when(a["type"].isin(1, 28), a["value"]).otherwise(a["text"]).alias("cname")))
    out = rows.select(*keep, F.posexplode(F.concat(asked, told)).alias("place", "r"))
    return out.select(*keep, "place", "r.name", "r.type", scalars.dns_type_name(c("r.type")).alias("type_name"), "r.cname")
