"""Where a record's time goes: hops over interfaces, and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import scalars

c = F.col


def hops(records: DataFrame) -> DataFrame:
    """(record_id, direction, hop, ifname, ts_ns, used_ns) from records(record_id, direction, start_ns, attributes map<time-if, ns>): interfaces in
    order of their times, each with the time since the one before it, the first since start_ns."""
    rows = records.select("record_id", "direction", "start_ns", F.explode(F.map_entries("attributes")).alias("x"))
    rows = rows.select("record_id", "direction", "start_ns", scalars.interface_name(c("x.key")).alias("ifname"), c("x.value").alias("ts_ns"))
    w = Window.partitionBy("record_id", "direction").orderBy("ts_ns", "ifname")
    return rows.select("record_id", "direction", F.row_number().over(w).alias("hop"), "ifname", "ts_ns", (c("ts_ns") - F.coalesce(F.lag("ts_ns").over(w), c("start_ns"))).alias("used_ns"))


def stages(records: DataFrame) -> DataFrame:
    """(record_id, place, stage, ns): the stages of a record in order, those that are known.

    Client: process to network, network and peer, network to socket, socket to process. Server: network to socket, socket
    to process, process, process to network.
    """
    s = lambda name, ns: F.struct(F.lit(name).alias("stage"), ns.cast("long").alias("ns"))
    rest = c("total_ns") - F.coalesce("black_box_ns", F.lit(0)) - F.coalesce("read_socket_ns", F.lit(0)) - F.coalesce("copy_to_sock_ns", F.lit(0))
    client = F.array(s("process to network", rest), s("network", c("black_box_ns")), s("network to socket", c("copy_to_sock_ns")), s("socket to process", c("read_socket_ns")))
    server = F.array(s("network to socket", c("copy_to_sock_ns")), s("socket to process", c("read_socket_ns")), s("process", c("black_box_ns")), s("process to network", rest))
    rows = records.select("record_id", F.posexplode(F.when(c("side") == "client", client).otherwise(server)).alias("place", "x"))
    return rows.select("record_id", "place", "x.stage", "x.ns").where("ns is not null")
