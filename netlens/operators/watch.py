"""Lists of records: sorted, the most recent, in request order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions import names, scalars

c = F.col

#: What a list can be sorted by.
SORTS = {"start-time": "start_ns", "process": "pid", "conn": "conn_id", "protocol": "protocol", "total-time": "total_ns", "req-size": "req_size", "resp-size": "resp_size", "net/internal": "black_box_ns", "read-socket": "read_socket_ns"}


def watch(records: DataFrame, sort_by: str = "start-time", descending: bool = False, wide: bool = False) -> DataFrame:
    """The display columns of records, sorted; wide adds the opaque and the socket time."""
    key = c(SORTS[sort_by])
    ms = lambda x: scalars.displayed(scalars.ns_to_ms(c(x)))
    out = [c("record_id"), scalars.time_ms(c("start_ns")).alias("start_time"), c("pid"), scalars.connection_label(c("local_addr"), c("local_port"), c("remote_addr"), c("remote_port"), c("side")).alias("connection"),
           names.protocol_name(c("protocol")).alias("protocol"), ms("total_ns").alias("total"), c("req_size"), c("resp_size")]
    if wide:
        out += [ms("black_box_ns").alias("net_internal"), ms("read_socket_ns").alias("read_socket")]
    return records.orderBy(key.desc() if descending else key.asc(), "record_id").select(*out)


def most_recent(records: DataFrame, n: int = 100) -> DataFrame:
    """The n records that came last."""
    return records.orderBy(c("start_ns").desc(), c("record_id").desc()).limit(n)


def in_request_order(records: DataFrame) -> DataFrame:
    return records.orderBy("start_ns", "record_id")
