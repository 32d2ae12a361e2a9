"""Pairs annotated as they come in: packet and TLS events wait for the pairs whose bytes they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions.names import LAST_EGRESS
from netlens.operators import annotate as batch
from netlens.streaming.run import event_time
from netlens.streaming.state import LANES, Replaying, replayed

_EVENT = "struct<is_req:boolean,step:int,seq:bigint,len:bigint,ts_ns:bigint,ts_delta:bigint,first_ns:bigint,last_ns:bigint>"
OUT = f"conn_id long, pair_id long, side string, is_ssl boolean, req_ts long, resp_ts long, req_maps boolean, resp_maps boolean, req_kern_len long, resp_kern_len long, events array<{_EVENT}>"

#: What a timeline row may have; kind is packet, tls or pair, and a row has null for what its kind lacks.
TIMELINE = {
    "conn_id": "long", "ts_ns": "long", "kind": "string", "step": "int", "egress": "boolean", "seq": "long", "len": "long", "ts_delta": "long", "ifname": "string", "syscall_seq": "long", "syscall_len": "long",
    "pair_id": "long", "side": "string", "is_ssl": "boolean", "req_ts": "long", "req_start": "long", "req_end": "long", "resp_start": "long", "resp_end": "long",
}
_FIELDS = [k for k in TIMELINE if k != "conn_id"]


class _Matching(Replaying):
    """What is kept of a connection: packets by (step, seq, interface), TLS events by (egress, seq), pairs by when they settle, the bytes
    that are consumed in each direction, and the time of its last row. See matched()."""

    KEYS, HELD = ("conn_id",), tuple(_FIELDS)

    def __init__(self, settle_ms: int, idle_ms: int):
        self.settle, self.idle = settle_ms * 1_000_000, idle_ms * 1_000_000

    def open(self, key, was):
        self.packets, self.tls, self.pairs, self.marks, self.seen = was or ({}, {}, {}, {(what, egress): 0 for what in ("kern", "tls") for egress in (True, False)}, None)

    def close_call(self):
        if self.seen is None:
            return None, None
        return (self.packets, self.tls, self.pairs, self.marks, self.seen), min([k[0] + 1 for k in self.pairs] + [self.seen + self.idle + 1])

    def pass_time(self, key, now):
        out = []
        while self.pairs and min(self.pairs)[0] < now:
            due = min(self.pairs)
            out.append(self._settled(key, due[1], self.pairs.pop(due)))
        if self.seen is not None and self.seen + self.idle < now and not self.pairs:
            self.packets.clear()
            self.tls.clear()
            self.marks, self.seen = dict.fromkeys(self.marks, 0), None
        return out

    def replay(self, key, row):
        r = dict(zip(_FIELDS, row, strict=True))
        self.seen = r["ts_ns"]
        if r["kind"] == "pair":
            self.pairs[(r["ts_ns"] + self.settle, r["pair_id"])] = tuple(r[k] for k in ("side", "is_ssl", "req_ts", "ts_ns", "req_start", "req_end", "resp_start", "resp_end"))
        elif r["kind"] == "tls":
            if r["seq"] >= self.marks["tls", r["egress"]]:
                self.tls.setdefault((r["egress"], r["seq"]), (r["len"], r["syscall_seq"], r["syscall_len"]))
        elif r["seq"] >= self.marks["kern", r["step"] <= LAST_EGRESS]:
            # of events of one step (and of network cards, one interface) at one seq the earliest counts: that which is replayed first
            nic = r["ifname"] if r["step"] in batch.NIC_STEPS and r["ifname"] is not None else ""
            self.packets.setdefault((r["step"], r["seq"], nic), (r["len"], r["ts_ns"], r["ts_delta"] or 0))
        return []

    def _kernel_range(self, is_ssl, egress, start, end):
        """(first byte, end, whether all TLS events map, or None without any) of a message's bytes."""
        if not is_ssl:
            return start, end, None
        inside = sorted((k[1], *v) for k, v in self.tls.items() if k[0] == egress and start <= k[1] < end)
        if not inside:
            return 0, 0, None
        known = [e[2] for e in inside if e[2] and e[2] > 0]
        valid = all(e[3] and e[3] > 0 for e in inside)
        return (known[0], inside[-1][2] + inside[-1][3], valid) if known else (0, 0, valid)

    def _settled(self, key, pair_id, pair):
        side, is_ssl, req_ts, resp_ts, *bounds = pair
        made, events = {}, []
        for name, is_req, start, end in (("req", True, *bounds[:2]), ("resp", False, *bounds[2:])):
            egress = is_req == (side == "client")
            low, high, maps = self._kernel_range(is_ssl, egress, start, end)
            made[f"{name}_maps"], made[f"{name}_kern_len"] = maps, high - low if high > low else None
            met: dict[tuple, list] = {}
            for (step, seq, _), v in self.packets.items():
                if (step <= LAST_EGRESS) == egress and v[0] > 0 and seq < high and seq + v[0] > low:
                    met.setdefault((step, seq), []).append(v)
            for (step, seq), some in met.items():
                size, ts, delta = min(some, key=lambda v: (v[1], v[0]))
                events.append((seq, ts, dict(is_req=is_req, step=step, seq=seq, len=size, ts_ns=ts, ts_delta=delta, first_ns=ts, last_ns=max(v[1] for v in some))))
            self._consumed("kern", egress, high)
            if is_ssl:
                self._consumed("tls", egress, end)
        events.sort(key=lambda e: (e[0], e[1], e[2]["step"]))
        return dict(conn_id=key[0], pair_id=pair_id, side=side, is_ssl=is_ssl, req_ts=req_ts, resp_ts=resp_ts, req_maps=made["req_maps"], resp_maps=made["resp_maps"],
                   req_kern_len=made["req_kern_len"], resp_kern_len=made["resp_kern_len"], events=[e[2] for e in events])

    def _consumed(self, what, egress, end):
        """Raises the mark of a direction: events that begin below it are done with, whether they are here or still to come."""
        mark = self.marks[what, egress] = max(self.marks[what, egress], end)
        kept = self.packets if what == "kern" else self.tls
        for k in [k for k in kept if k[1] < mark and (k[0] if what == "tls" else k[0] <= LAST_EGRESS) == egress]:
            del kept[k]


def matched(timeline: DataFrame, settle_ms: int = 1000, idle_ms: int = 600_000, delay: str = "1 second", lanes: int = LANES) -> DataFrame:
    """Pairs of a stream with the packet events that their byte ranges meet, once they have settled: conn_id, pair_id, side, is_ssl, req_ts,
    resp_ts, req_maps, resp_maps, req_kern_len, resp_kern_len, events (in order of bytes).

    timeline has the columns of TIMELINE that its kinds need: packets (step, seq, len, ts_delta, ifname), TLS events (egress, seq, len,
    syscall_seq, syscall_len), and pairs (pair_id, side, is_ssl, req_ts, req_start .. resp_end; ts_ns is when the response came),
    whose ranges are in the stream's bytes, of TLS in plain ones. Rows of a connection are taken in order of event time once the
    watermark has passed them. A pair settles settle_ms after its response. Of TLS the kernel ranges under the message count; a
    direction whose TLS events do not all map says so in req_maps or resp_maps.

    What a pair has taken is consumed: a mark for each direction, of kernel bytes and of TLS bytes, stands at the end of its range, and
    events that begin below it go, also those that come later. State is bounded by these marks, and by time: a connection without
    any event for idle_ms of event time is forgotten with its marks. Connections of one of `lanes` parts share a call. Start it inside state.rocksdb(). A row without a
    time is left out.
    """
    rows = timeline.where("ts_ns is not null").withColumn("at", event_time("ts_ns")).withWatermark("at", delay)
    has = set(timeline.columns)
    rows = rows.select("at", *((F.col(k) if k in has else F.lit(None)).cast(t).alias(k) for k, t in TIMELINE.items()))
    return replayed(rows, _Matching(settle_ms, idle_ms), OUT, lanes)


def annotated(timeline: DataFrame, trace_devices: bool = True, trace_sockets: bool = True, **options) -> DataFrame:
    """matched() with what the batch operator tells of a pair: start_ns, end_ns, total_ns, black_box_ns, read_socket_ns, copy_to_sock_ns."""
    return batch.annotate_arrays(matched(timeline, **options), trace_devices, trace_sockets)
