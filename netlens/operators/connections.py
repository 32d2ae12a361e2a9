"""Connections as intervals, and lookups into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import names
from netlens.operators import scan

c = F.col


def lifecycles(conn_events: DataFrame) -> DataFrame:
    """(tgid_fd, start_ns, next_ns, close_ns): one row for each connect; it ends with the first close after it, up to and with the
    next connect of the same descriptor."""
    # a close at the very time of a connect belongs to the connection before it
    order = Window.partitionBy("tgid_fd").orderBy("ts_ns", (c("kind") == "connect").cast("int"), "seq")
    rows = conn_events.where(c("kind").isin("connect", "close"))
    rows = rows.withColumn("_n", F.sum((c("kind") == "connect").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_n > 0")
    out = rows.groupBy("tgid_fd", "_n").agg(F.min(F.when(c("kind") == "connect", c("ts_ns"))).alias("start_ns"), F.min(F.when(c("kind") == "close", c("ts_ns"))).alias("close_ns"))
    out = out.withColumn("next_ns", F.lead("start_ns").over(Window.partitionBy("tgid_fd").orderBy("_n")))
    return out.select("tgid_fd", "start_ns", "next_ns", F.when(c("close_ns") > c("start_ns"), c("close_ns")).alias("close_ns"))


def lookup(events: DataFrame, connections: DataFrame, blocks: int | None = None) -> DataFrame:
    """events(tgid_fd, ts_ns, seq) with the start_ns of their connection: the newest one of the descriptor if it began before the event,
    else the newest earlier one that covers it. Events without one go.

    An as-of join by union and window: the events of a descriptor meet its connections in order of time, once. With `blocks` a busy
    descriptor's events are cut into blocks (scan.running).
    """
    of = Window.partitionBy("tgid_fd").orderBy("start_ns", c("next_ns").asc_nulls_last())
    starts = connections.withColumn("_conn", F.struct("start_ns", "close_ns", "next_ns"))
    starts = starts.select("tgid_fd", c("start_ns").alias("ts_ns"), "_conn", F.lag("_conn").over(of).alias("_last"))
    kind = starts.schema["_conn"].dataType
    both = events.withColumns({"_conn": F.lit(None).cast(kind), "_last": F.lit(None).cast(kind), "_event": F.lit(1)}).unionByName(starts.withColumn("_event", F.lit(0)), allowMissingColumns=True)
    # connections come before events of the same time; the one before the last is kept too, for events at the start of the newest
    rows = scan.running(both, ["tgid_fd"], ["ts_ns", "_event"], {"_conn": ("last", c("_conn"), True), "_before": ("last", c("_last"), True)}, blocks)
    covers = lambda x: (c(f"{x}.start_ns") <= c("ts_ns")) & (c("ts_ns") <= F.coalesce(f"{x}.close_ns", f"{x}.next_ns"))
    newest = c("_conn.next_ns").isNull()
    start = (F.when(newest & (c("_conn.start_ns") < c("ts_ns")), c("_conn.start_ns")).when(~newest & covers("_conn"), c("_conn.start_ns"))
             .when(c("_before").isNotNull() & covers("_before") & (c("_before.next_ns") == c("ts_ns")), c("_before.start_ns")))
    return rows.where("_event = 1").withColumn("start_ns", start).where("start_ns is not null").drop("_conn", "_last", "_before", "_event")


def first_packets(packets: DataFrame, connections: DataFrame) -> DataFrame:
    """First packets by their four-tuple; they stand for the first byte of the stream."""
    return packets.join(connections, ["local_addr", "local_port", "remote_addr", "remote_port"]).withColumn("seq", F.lit(1).cast("long"))


def resolve_nat(records: DataFrame, nat_flows: DataFrame) -> DataFrame:
    """records with real_remote_addr and real_remote_port: what address translation makes of the connection, in either direction."""
    there = nat_flows.select(c("sip").alias("local_addr"), c("sport").alias("local_port"), c("dip").alias("remote_addr"), c("dport").alias("remote_port"), c("to_dip").alias("_addr"), c("to_dport").alias("_port"))
    back = nat_flows.select(c("to_dip").alias("local_addr"), c("to_dport").alias("local_port"), c("to_sip").alias("remote_addr"), c("to_sport").alias("remote_port"), c("sip").alias("_addr"), c("sport").alias("_port"))
    keys = ["local_addr", "local_port", "remote_addr", "remote_port"]
    flows = there.unionByName(back).groupBy(*keys).agg(F.min(F.struct("_addr", "_port")).alias("_to"))
    out = records.join(flows, keys, "left")
    return out.withColumns({"real_remote_addr": F.coalesce("_to._addr", "remote_addr"), "real_remote_port": F.coalesce("_to._port", "remote_port")}).drop("_to")


def counters(conn_events: DataFrame) -> DataFrame:
    opened, closed = F.count_if(c("kind") == "connect"), F.count_if(c("kind") == "close")
    return conn_events.groupBy("tgid_fd").agg(opened.alias("added"), closed.alias("closed"), (opened - closed).alias("open"))


def handshakes(kern: DataFrame) -> DataFrame:
    """(conn_id, syn_ns, ack_ns, handshake_ns): first SYN that comes in, first ACK that goes out, and the time from the one to the other."""
    ack, syn = names.TCP_FLAGS["ACK"], names.TCP_FLAGS["SYN"]
    s = F.min(F.when((c("step") == names.IP_IN) & (c("flags").bitwiseAND(F.lit(syn)) != 0), c("ts_ns")))
    a = F.min(F.when((c("step") <= names.LAST_EGRESS) & (c("flags").bitwiseAND(F.lit(ack)) != 0), c("ts_ns")))
    return kern.groupBy("conn_id").agg(s.alias("syn_ns"), a.alias("ack_ns")).withColumn("handshake_ns", c("ack_ns") - c("syn_ns"))


def inferred_protocol(conn_events: DataFrame) -> DataFrame:
    """Protocol and role of a descriptor: those of the first inference."""
    first = F.min_by(F.struct("protocol", "role"), F.struct("ts_ns", "seq"))
    return conn_events.where(c("kind") == "protocol_infer").groupBy("tgid_fd").agg(first.alias("f")).select("tgid_fd", "f.protocol", "f.role")


def events_per_connection(kern: DataFrame) -> DataFrame:
    return kern.groupBy("conn_id").agg(F.count(F.lit(1)).alias("events"))
