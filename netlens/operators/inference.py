"""Protocols and roles of connections, from the payloads that they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import scalars

c = F.col


def tagged_reads(segments: DataFrame, keys: tuple[str, ...] = ("conn_id",), total: str | None = None) -> DataFrame:
    """segments(keys, ts_ns, arrival, payload, ...), without their payload, with protocol, message and prepended of each: what its bytes
    tell, a length that the read before brought included. `total` names the column of a call's whole length where payloads are cut.

    Only the bytes that the rules look at go to the window, which orders the reads of a connection by time and arrival.
    """
    heads = segments.withColumns({"_n": F.octet_length("payload"), "_head": F.substring("payload", 1, scalars.TAG_HEAD), "_tail": F.expr(f"substring(payload, -{scalars.TAG_TAIL}, {scalars.TAG_TAIL})")}).drop("payload")
    before = F.lag(F.when(c("_n") == 4, c("_head"))).over(Window.partitionBy(*keys).orderBy("ts_ns", "arrival"))
    rows = heads.withColumn("_before", before)
    tag = scalars.protocol_tag(c("_head"), c("_n"), c(total) if total else None, c("_before"), c("_tail"))
    rows = rows.withColumn("_tag", tag)
    return rows.select("*", "_tag.protocol", "_tag.message", "_tag.prepended").drop("_n", "_head", "_tail", "_before", "_tag")


def inferred_connections(segments: DataFrame, keys: tuple[str, ...] = ("conn_id",), total: str | None = None) -> DataFrame:
    """(keys, protocol, role, ts_ns, prepended) of connections by their first read that tells a protocol. segments have egress, too: who sends
    a request or receives a response is the client; a message of either kind leaves the role unknown."""
    tags = tagged_reads(segments, keys, total).where("protocol is not null")
    first = tags.groupBy(*keys).agg(F.min_by(F.struct("protocol", "message", "egress", "ts_ns", "prepended"), F.struct("ts_ns", "arrival")).alias("f"))
    role = F.when(c("f.message") == "any", "unknown").when(c("f.egress") == (c("f.message") == "req"), "client").otherwise("server")
    return first.select(*keys, "f.protocol", role.alias("role"), "f.ts_ns", "f.prepended")
