"""Byte streams of connections put together as segments come in: fused ranges, epochs, a bound of bytes, heads that are given up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.operators.reassembly import MIB, WRAP
from netlens.streaming.run import event_time
from netlens.streaming.state import LANES, Replaying, replayed

OUT = "conn_id long, direction string, epoch long, start long, end long, segments long, bytes long, first_ns long, last_ns long, reason string"


class _Reassembly(Replaying):
    """What is kept of a stream: its ranges by where they start, (end, segments, bytes, first_ns, grown_ns); the segments in them by seq; the
    number of the epoch and the mark. See ranges()."""

    KEYS, HELD = ("conn_id", "direction"), ("ts_ns", "arrival", "seq", "len", "closes")

    def __init__(self, capacity: int, stuck_ms: int):
        self.capacity, self.stuck = capacity, stuck_ms * 1_000_000

    def open(self, key, was):
        self.ranges, self.seqs, self.epoch, self.mark = was or ({}, {}, 0, -1)

    def close_call(self):
        kept = (self.ranges, self.seqs, self.epoch, self.mark)
        return None if kept == ({}, {}, 0, -1) else kept, self.ranges[min(self.ranges)][4] + self.stuck if self.ranges else None

    def _left(self, key, start, reason):
        """A range leaves: its row. What comes below its end later on is not taken up again."""
        end, segments, size, first, grown = self.ranges.pop(start)
        for seq in [s for s in self.seqs if start[0] <= s[0] < end]:
            del self.seqs[seq]
        self.mark = max(self.mark, end)
        return dict(conn_id=key[0], direction=key[1], epoch=self.epoch, start=start[0], end=end, segments=segments, bytes=size, first_ns=first, last_ns=grown, reason=reason)

    def _cleared(self, key, reason):
        out = [self._left(key, start, reason) for start in sorted(self.ranges)]
        self.seqs.clear()
        self.mark = -1
        return out

    def pass_time(self, key, now):
        out = []
        while self.ranges and self.ranges[min(self.ranges)][4] + self.stuck < now:
            out.append(self._left(key, min(self.ranges), "stuck"))
        return out

    def replay(self, key, row):
        ts, _, seq, size, closes = row
        out = []
        if size:
            out += self._added(key, ts, seq, size)
        if closes:
            out += self._cleared(key, "close")
            self.epoch = 0
        return out

    def _added(self, key, ts, seq, size):
        out, dropped = [], dict(conn_id=key[0], direction=key[1], epoch=self.epoch, start=seq, end=seq + size, segments=1, bytes=size, first_ns=ts, last_ns=ts, reason="before head")
        if (seq,) in self.seqs:
            return out
        low = min(self.ranges)[0] if self.ranges else self.mark
        high = max([r[0] for r in self.ranges.values()], default=self.mark)
        if high >= 0:
            if seq - high >= WRAP or seq < low and low - seq < WRAP and low - seq >= MIB:
                return [dropped]  # from before a wrap, or too far behind
            if high - seq >= WRAP or seq - high >= MIB:
                out += self._cleared(key, "wrap" if high - seq >= WRAP else "gap")
                self.epoch += 1
        end = seq + size
        if end <= self.mark:
            return [*out, dropped]
        start = max(seq, self.mark)
        meets = [(s, r) for s, r in self.ranges.items() if s[0] <= end and start <= r[0]]
        fresh = end - start > sum(min(end, r[0]) - max(start, s[0]) for s, r in meets)
        one = (max([end, *(r[0] for _, r in meets)]), 1 + sum(r[1] for _, r in meets), size + sum(r[2] for _, r in meets), min([ts, *(r[3] for _, r in meets)]), ts if fresh else max(r[4] for _, r in meets))
        for s, _ in meets:
            del self.ranges[s]
        self.ranges[(min([start, *(s[0] for s, _ in meets)]),)] = one
        self.seqs[(seq,)] = (ts,)
        while self.ranges and max(r[0] for r in self.ranges.values()) - min(self.ranges)[0] > self.capacity:
            out.append(self._left(key, min(self.ranges), "capacity"))
        return out


def ranges(segments: DataFrame, capacity: int = MIB, stuck_ms: int = 1000, delay: str = "1 second", lanes: int = LANES) -> DataFrame:
    """Fused ranges of streams, each with a row when it leaves: conn_id, direction, epoch, start, end, segments, bytes, first_ns, last_ns
    (when it last grew) and reason. segments(conn_id long, direction string, seq, len, ts_ns, arrival[, closes boolean]); seq has 32 bits.

    Segments are taken in order of time and arrival once the watermark has passed them. Of segments at one seq the first counts;
    ranges that overlap or touch are fused, as in the batch operator. They leave with reason
    - "wrap" if seq falls by half its range, "gap" if it jumps MIB ahead: all ranges go and a new epoch begins;
    - "capacity" if a stream spans more than `capacity` bytes: the oldest range goes, until the rest fits;
    - "stuck" if the head, the lowest range, did not grow for stuck_ms of event time: the next one is the head then;
    - "close" with a segment that closes its connection; epochs begin at 0 again.
    A segment MIB or more before the head, or below what has left, is not taken up: a row of its own, reason "before head".

    State is bounded by `capacity` bytes of ranges and segments for each stream, and by time: whatever waits goes by an event-time
    timer stuck_ms after it last grew (a state's own TTL runs on the clock of the machine, so results would depend on it). The
    number of the epoch and the end of what has left stay with a stream until its connection closes. Streams of one of `lanes` parts share a call. Start it inside state.rocksdb().
    A segment without a time is left out, one without seq brings no bytes.
    """
    rows = segments.where("ts_ns is not null").withColumn("at", event_time("ts_ns")).withWatermark("at", delay)
    closes = F.coalesce("closes", F.lit(False)) if "closes" in segments.columns else F.lit(False)
    number = lambda name: F.col(name).cast("long").alias(name)
    rows = rows.select("at", F.col("conn_id").cast("long").alias("conn_id"), "direction", number("ts_ns"), number("arrival"), number("seq"), F.when(F.col("seq").isNotNull(), F.col("len").cast("long")).alias("len"), closes.alias("closes"))
    return replayed(rows, _Reassembly(capacity, stuck_ms), OUT, lanes)
