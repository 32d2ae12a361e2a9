"""Packet events deduplicated, and pairs annotated with what they tell: durations and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import names
from netlens.functions.names import DEV_IN, DEV_OUT, NIC_IN, SYSCALL_IN, SYSCALL_OUT, TCP_IN, USER_COPY

c = F.col
NIC_STEPS = (names.NIC_OUT, NIC_IN, DEV_OUT, DEV_IN)


def dedupe_events(kern: DataFrame) -> DataFrame:
    """One event for each (conn_id, step, seq): the earliest; of equal times the shorter. Only the fields that are read survive."""
    best = F.min(F.struct("ts_ns", "len")).alias("b")
    return kern.groupBy("conn_id", "step", "seq").agg(best).select("conn_id", "step", "seq", "b.ts_ns", "b.len")


def nic_times(kern: DataFrame) -> DataFrame:
    """(conn_id, step, seq, times, first_ns, last_ns): interface to its earliest time, and the extremes over interfaces."""
    each = kern.where(c("step").isin(*NIC_STEPS)).groupBy("conn_id", "step", "seq", "ifname").agg(F.min("ts_ns").alias("t"))
    out = each.groupBy("conn_id", "step", "seq").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ifname", "t")))).alias("times"))
    return out.withColumns({"first_ns": F.array_min(F.map_values("times")), "last_ns": F.array_max(F.map_values("times"))})


def event_arrays(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Events of a pair as an array in order of their bytes."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "ts_ns", "len")))
    return matched.groupBy(*keys).agg(rows.alias("e")).select(*keys, F.transform("e", lambda x: F.struct(x["len"].alias("ByteSize"), x["ts_ns"].alias("Timestamp"))).alias("events"))


def _ingress(value) -> Column:
    """What `value` gives for the interface that packets come in by; where no such event was seen, for the device."""
    return F.coalesce(value(NIC_IN), value(DEV_IN))


def ingress_nic(kern: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nic_in_ns): when the interface, or else the device, first had what comes in."""
    return kern.groupBy(*keys).agg(_ingress(lambda step: F.min(F.when(c("step") == step, c("ts_ns")))).alias("nic_in_ns"))


def _wanted(first, last, least, most) -> dict[str, Column]:
    """The values that the rules below need, of request (q_) and response (r_) events. The arguments give, for a direction and a step, the
    value of the first or last event by seq, or the least or greatest value."""
    out = {}
    for p in ("q", "r"):
        out |= {
            f"{p}_write_min": least(p, SYSCALL_OUT, "ts_ns"), f"{p}_write_last_end": last(p, SYSCALL_OUT, "end_ns"),
            f"{p}_read_end_max": most(p, SYSCALL_IN, "end_ns"), f"{p}_read_first": first(p, SYSCALL_IN, "ts_ns"), f"{p}_read_last_end": last(p, SYSCALL_IN, "end_ns"),
            f"{p}_nic_start": _ingress(lambda step, p=p: first(p, step, "ts_ns")), f"{p}_nic_first": _ingress(lambda step, p=p: first(p, step, "first_ns")),
            f"{p}_nic_max": _ingress(lambda step, p=p: most(p, step, "first_ns")),
            f"{p}_dev_min": least(p, DEV_OUT, "last_ns"), f"{p}_dev_last": last(p, DEV_OUT, "last_ns"),
            f"{p}_tcp_first": first(p, TCP_IN, "ts_ns"), f"{p}_tcp_last": last(p, TCP_IN, "ts_ns"), f"{p}_copy_first": first(p, USER_COPY, "ts_ns"), f"{p}_copy_last": last(p, USER_COPY, "ts_ns"),
        }
    return out


def _summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """Those values of a table of events, in one aggregate."""
    on = lambda p, step, value: F.when((c("is_req") if p == "q" else ~c("is_req")) & (c("step") == step), value)
    order = F.struct("seq", "ts_ns")
    values = _wanted(lambda p, step, v: F.min_by(on(p, step, c(v)), on(p, step, order)), lambda p, step, v: F.max_by(on(p, step, c(v)), on(p, step, order)),
                     lambda p, step, v: F.min(on(p, step, c(v))), lambda p, step, v: F.max(on(p, step, c(v))))
    return events.groupBy(*keys).agg(*(x.alias(k) for k, x in values.items()))


def annotate_arrays(pairs: DataFrame, trace_devices: bool = True, trace_sockets: bool = True) -> DataFrame:
    """annotate() of pairs that hold their events in an array `events` in order of seq and time (is_req, step, seq, ts_ns, ts_delta, first_ns,
    last_ns): no aggregate, so it stands behind a stream, too."""
    unseen = [*(() if trace_devices else DEVICE_STEPS), *(() if trace_sockets else SOCKET_STEPS)]
    some = lambda p, step: F.filter("events", lambda e: (e["is_req"] == F.lit(p == "q")) & (e["step"] == F.lit(step)) & F.lit(step not in unseen))
    value = {"ts_ns": lambda e: e["ts_ns"], "end_ns": lambda e: e["ts_ns"] + F.coalesce(e["ts_delta"], F.lit(0)), "first_ns": lambda e: F.coalesce(e["first_ns"], e["ts_ns"]), "last_ns": lambda e: F.coalesce(e["last_ns"], e["ts_ns"])}
    each = lambda p, step, v: F.transform(some(p, step), value[v])
    values = _wanted(lambda p, step, v: F.get(each(p, step, v), F.lit(0)), lambda p, step, v: F.try_element_at(each(p, step, v), F.lit(-1)), lambda p, step, v: F.array_min(each(p, step, v)), lambda p, step, v: F.array_max(each(p, step, v)))
    return _ruled(pairs.withColumns(values), pairs.columns, trace_devices, trace_sockets)


#: Events that are seen only while devices, or sockets, are traced.
DEVICE_STEPS, SOCKET_STEPS = (NIC_IN, DEV_IN, DEV_OUT), (TCP_IN, USER_COPY)


def annotate(pairs: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("conn_id", "pair_id"), trace_devices: bool = True, trace_sockets: bool = True) -> DataFrame:
    """pairs(keys, side, is_ssl, req_maps, resp_maps, req_ts, resp_ts, ...) with start_ns, end_ns, total_ns, black_box_ns, read_socket_ns and
    copy_to_sock_ns; null where a time cannot be told. events(keys, is_req, step, seq, ts_ns, ts_delta, first_ns, last_ns) are the packet
    events that a pair's byte ranges meet: an event ends ts_delta after ts_ns; first_ns and last_ns are the extremes over interfaces,
    ts_ns where there is but one time.

    Client: from the first write to the end of the last read; the network's share lies between what leaves the device and what comes in.
    Server: from what comes in first to what leaves last; the process's share lies between first read and end of last write. Of TLS
    traffic a direction counts only if all its TLS events map to kernel ranges (req_maps, resp_maps; null: there are none, so they
    do). What is not traced is taken as unseen: without devices a server's total is the process's share, without sockets the time of
    reading runs from the interface to the end of the last read.
    """
    unseen = [*(() if trace_devices else DEVICE_STEPS), *(() if trace_sockets else SOCKET_STEPS)]
    e = events.where(~c("step").isin(*unseen)) if unseen else events
    has = set(events.columns)
    e = e.withColumns({"first_ns": F.coalesce("first_ns", "ts_ns"), "last_ns": F.coalesce("last_ns", "ts_ns"), "end_ns": c("ts_ns") + (F.coalesce("ts_delta", F.lit(0)) if "ts_delta" in has else F.lit(0))})
    return _ruled(pairs.join(_summary(e, list(keys)), list(keys), "left"), pairs.columns, trace_devices, trace_sockets)


def _ruled(x: DataFrame, columns: list[str], trace_devices: bool, trace_sockets: bool) -> DataFrame:
    """`columns` of pairs that have those values, with the measures."""
    client, diff = c("side") == "client", c("resp_ts") - c("req_ts")
    pick = lambda a, b: F.when(client, a).otherwise(b)
    inn, out = (lambda name: pick(c(f"r_{name}"), c(f"q_{name}"))), (lambda name: pick(c(f"q_{name}"), c(f"r_{name}")))
    maps = lambda name: F.coalesce(c(name), F.lit(True)) if name in columns else F.lit(True)
    plain = ~c("is_ssl") if "is_ssl" in columns else F.lit(True)
    can_read, can_write = plain | pick(maps("resp_maps"), maps("req_maps")), plain | pick(maps("req_maps"), maps("resp_maps"))
    can_both = can_read & can_write
    read, write = inn("read_first").isNotNull(), out("write_min").isNotNull()
    start_c, end_c = F.when(can_write & write, out("write_min")).otherwise(c("req_ts")), F.when(can_read & read, inn("read_end_max")).otherwise(c("resp_ts"))
    start_s, end_s = F.coalesce(inn("nic_first"), inn("tcp_first"), inn("copy_first"), inn("read_first")), F.coalesce(out("dev_last"), out("write_last_end"))
    total_c = F.when(read & write & can_both, end_c - start_c).otherwise(diff)
    box_c = F.when(can_both, inn("nic_max") - out("dev_min"))
    box_s = F.when(read & write & can_both, out("write_last_end") - inn("read_first")).otherwise(diff)
    total_s = F.when(can_both, end_s - start_s) if trace_devices else box_s
    read_c = F.when(can_read, F.coalesce(inn("copy_last"), inn("read_last_end")) - inn("tcp_first"))
    read_s = F.when(can_read, inn("copy_last") - inn("tcp_first"))
    copied = F.when(pick(can_read, can_write), inn("tcp_last") - inn("nic_start"))
    read_ns = pick(read_c, read_s)
    if not trace_sockets:
        read_ns = F.coalesce(F.when(can_read, inn("read_last_end") - inn("nic_first")), read_ns)
    made = {"start_ns": pick(start_c, start_s), "end_ns": pick(end_c, end_s), "total_ns": pick(total_c, total_s), "black_box_ns": pick(box_c, box_s), "read_socket_ns": read_ns, "copy_to_sock_ns": copied}
    return x.withColumns(made).select(*columns, *made)


def sizes(pairs: DataFrame) -> DataFrame:
    """Plain traffic: bytes of the messages. TLS: bytes of the kernel ranges, and the messages' bytes as plain-text sizes."""
    ssl = c("is_ssl")
    return pairs.withColumns({
        "req_plain_size": F.when(ssl, c("req_size")), "resp_plain_size": F.when(ssl, c("resp_size")),
        "req_size": F.when(ssl, c("req_kern_len")).otherwise(c("req_size")), "resp_size": F.when(ssl, c("resp_kern_len")).otherwise(c("resp_size"))})
