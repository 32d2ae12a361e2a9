"""Requests and responses of streams: by id with a timeout, and in order."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netlens.streaming.run import event_time
from netlens.streaming.state import LANES, dealt

c = F.col


def pair_by_id(messages: DataFrame, keys: tuple[str, ...] = ("conn_id", "corr_id"), timeout: str = "5 minutes", delay: str = "1 second") -> DataFrame:
    """Every response with the requests of its id that are not later and not older than the timeout: a join of two streams whose
    state the watermarks bound."""
    rows = messages.withColumn("at", event_time("ts_ns")).withWatermark("at", delay)
    req = rows.where("is_req").select(*[c(k).alias(f"q_{k}") for k in keys], c("at").alias("q_at"), c("ts_ns").alias("req_ts"), c("seq").alias("req_seq"))
    resp = rows.where("not is_req").select(*keys, "at", c("ts_ns").alias("resp_ts"), c("seq").alias("resp_seq"))
    on = [c(f"q_{k}") == c(k) for k in keys] + [c("at") >= c("q_at"), c("at") <= c("q_at") + F.expr(f"INTERVAL {timeout}")]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return req.join(resp, cond).select(*keys, "req_ts", "resp_ts", "req_seq", "resp_seq")


def _table(raw: bytes | None, width: int) -> np.ndarray:
    """Columns of longs from a state."""
    return np.frombuffer(raw or b"", dtype=np.int64).reshape(width, -1)


def _columns(rows: list[tuple], width: int) -> np.ndarray:
    return np.array(rows, dtype=np.int64).reshape(-1, width).T


def _came(pdfs: Iterator[pd.DataFrame], names: list[str], width: int) -> list[np.ndarray]:
    return [pdf[names].to_numpy(dtype=np.int64).T.reshape(width, -1) for pdf in pdfs]


_STATE = "held binary, waiting binary, told binary"
#: How long a request waits for its response.
KEEP_MS = 300_000
#: Rules by name; whether requests come first at equal times.
RULES = {"fifo": False, "correlation": True, "opaque": True, "queued": True}
#: Stands for a null number of a message.
_NO_SEQ = -(1 << 63)


def _replaying(rule: str, keys: tuple[str, ...], keep_ms: int):
    requests_first, keep, n_keys = RULES[rule], keep_ms * 1_000_000, len(keys)
    names, width = [*keys, "ts_ns", "seq", "is_req"], len(keys) + 3

    def run(lane: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get if state.exists else (None, None, None)
        held = np.concatenate([_table(was[0], width), *([] if state.hasTimedOut else _came(pdfs, names, width))], axis=1)
        queues: defaultdict[tuple, deque] = defaultdict(deque)
        for row in _table(was[1], width - 1).T.tolist():
            queues[tuple(row[:n_keys])].append(tuple(row[n_keys:]))
        told = {tuple(row[:n_keys]): tuple(row[n_keys:]) for row in _table(was[2], width - 1).T.tolist()}
        # what the watermark has passed is complete, so it can be put in order
        now_ms = state.getCurrentWatermarkMs()
        limit, out = now_ms * 1_000_000, []
        due, held = held[:, held[n_keys] <= limit], held[:, held[n_keys] > limit]
        first = 1 - due[-1] if requests_first else due[-1]
        due = due[:, np.lexsort((due[-2], first, due[n_keys], *due[:n_keys][::-1]))]

        def expire(key, waiting, now):
            while waiting and waiting[0][0] + keep < now:
                q = waiting.popleft()
                r = told.pop(key, None)
                if r is not None:
                    out.append((*key, q[0], r[0], q[1], r[1]))

        for *key, t, s, is_req in due.T.tolist():
            key = tuple(key)
            waiting = queues[key]
            expire(key, waiting, t)
            if is_req:
                if rule in ("fifo", "opaque"):
                    waiting.clear()
                    waiting.append((t, s))
                elif rule == "queued" or not waiting:
                    waiting.append((t, s))
            elif rule == "correlation":
                if waiting:
                    told[key] = t, s
            elif waiting:
                q = waiting.popleft()
                out.append((*key, q[0], t, q[1], s))
        for key, waiting in queues.items():
            expire(key, waiting, limit)
        queues = {key: waiting for key, waiting in queues.items() if waiting}
        if held.size or queues:
            rest = _columns([(*key, *q) for key, waiting in queues.items() for q in waiting], width - 1), _columns([(*key, *r) for key, r in told.items()], width - 1)
            state.update((held.tobytes(), *(x.tobytes() for x in rest)))
            # a timer goes off once the watermark is greater than it
            wake = [-(-int(t) // 1_000_000) - 1 for t in held[n_keys].min(keepdims=True, initial=1 << 62)] + [(waiting[0][0] + keep) // 1_000_000 for waiting in queues.values()]
            state.setTimeoutTimestamp(max(min(wake), now_ms + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(_columns(out, n_keys + 4).T, columns=[*keys, "req_ts", "resp_ts", "req_seq", "resp_seq"])

    return run


def pair(messages: DataFrame, rule: str, keys: tuple[str, ...], delay: str = "1 second", keep_ms: int = KEEP_MS, lanes: int = LANES) -> DataFrame:
    """A batch rule over a stream: messages of a key wait until the watermark has passed them, then they are replayed in order.

    fifo: a response takes the latest request since the response before it. correlation: the first request of an id and the
    last response that comes within keep_ms, told when that time is over. opaque: the latest request and the first response
    after it. queued: a response takes the earliest request that waits. The state of a key is what still waits: messages
    ahead of the watermark, and requests, each for keep_ms of event time, after which a timer lets it go. However many wait, none
    is given up before: a queue that lost one would pair all that follow wrongly. Keys are longs; those of one of `lanes` parts share a
    call and a state. A message without a time is never passed, so it is left out.
    """
    mark, number = "_nulls", lambda name, x: x.cast("long").alias(name)
    nulls = sum((F.when(c(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    rows = messages.where("ts_ns is not null").withColumn("at", event_time("ts_ns")).withWatermark("at", delay)
    rows = rows.select(*(number(k, F.coalesce(c(k).cast("long"), F.lit(0))) for k in keys), number(mark, nulls), number("ts_ns", c("ts_ns")), number("seq", F.coalesce(c("seq").cast("long"), F.lit(_NO_SEQ))), number("is_req", F.coalesce("is_req", F.lit(False))), "at")
    every = (*keys, mark)
    made = ", ".join(f"{k} long" for k in (*every, "req_ts", "resp_ts", "req_seq", "resp_seq"))
    out = dealt(rows, every, lanes).applyInPandasWithState(_replaying(rule, every, keep_ms), made, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    known = [F.when(c(mark).bitwiseAND(F.lit(1 << i)) == 0, c(k)).alias(k) for i, k in enumerate(keys)]
    return out.select(*known, "req_ts", "resp_ts", *(F.nullif(c(k), F.lit(_NO_SEQ)).alias(k) for k in ("req_seq", "resp_seq")))


def pair_fifo(messages: DataFrame, delay: str = "1 second", keep_ms: int = KEEP_MS) -> DataFrame:
    return pair(messages, "fifo", ("conn_id",), delay, keep_ms)


_LATEST_STATE = "ts array<long>, seen long"


def _latest(most: int, idle_ms: int, keys: tuple[str, ...]):
    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, seen = state.get if state.exists else ([], 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, len(ts), seen - len(ts), min(ts), max(ts))], columns=[*keys, "held", "dropped", "first_ns", "last_ns"])
            return
        for pdf in pdfs:
            ts = sorted([*ts, *pdf.ts_ns.tolist()])[-most:]
            seen += len(pdf)
        state.update((list(ts), seen))
        state.setTimeoutTimestamp(max(ts[-1] // 1_000_000 + idle_ms, state.getCurrentWatermarkMs() + 1))

    return run


def latest_events(events: DataFrame, keys: tuple[str, ...] = ("conn_id", "step"), most: int = 300, idle_ms: int = 15_000, delay: str = "1 second") -> DataFrame:
    """Bounded memory of events: of each key the `most` latest are held, and older ones are dropped as new ones come. Once a key is idle for
    idle_ms its state goes, and it gives a row: keys, held, dropped, first_ns and last_ns of those held. Keys are longs."""
    rows = events.withColumn("at", event_time("ts_ns")).withWatermark("at", delay).select(*keys, "ts_ns", "at")
    out = ", ".join(f"{k} long" for k in (*keys, "held", "dropped", "first_ns", "last_ns"))
    return rows.groupBy(*keys).applyInPandasWithState(_latest(most, idle_ms, keys), out, _LATEST_STATE, "append", GroupStateTimeout.EventTimeTimeout)


_RANGES_STATE = "ts array<long>, seq array<long>, len array<long>, start array<long>, end array<long>, grown array<long>, mark long"


def _heads(timeout_ms: int):
    stale = timeout_ms * 1_000_000

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, seq, size, start, end, grown, mark = state.get if state.exists else ([], [], [], [], [], [], -1)
        held, ranges = list(zip(ts, seq, size, strict=True)), [list(x) for x in zip(start, end, grown, strict=True)]
        if not state.hasTimedOut:
            for pdf in pdfs:
                held += list(zip(pdf.ts_ns.tolist(), pdf.seq.tolist(), pdf.len.tolist(), strict=True))
        held.sort()
        limit, out, n = state.getCurrentWatermarkMs() * 1_000_000, [], 0

        def give_up(now):
            nonlocal mark
            while ranges and ranges[0][2] + stale < now:
                s, e, g = ranges.pop(0)
                out.append((*key, s, e, g))
                mark = e

        for t, s, size_ in held:
            if t > limit:
                break
            n += 1
            give_up(t)
            s, e = max(s, mark), s + size_
            if e <= s:
                continue  # below the mark: what is there is gone
            meets = [x for x in ranges if x[0] <= e and s <= x[1]]
            fresh = e - s > sum(min(e, x[1]) - max(s, x[0]) for x in meets)
            one = [min([s, *[x[0] for x in meets]]), max([e, *[x[1] for x in meets]]), t if fresh else max(x[2] for x in meets)]
            ranges[:] = sorted([x for x in ranges if x not in meets] + [one])
        give_up(limit)
        held = held[n:]
        if held or ranges:
            state.update((*([x[k] for x in held] for k in range(3)), *([x[k] for x in ranges] for k in range(3)), mark))
            wake = min([held[0][0] for _ in held[:1]] + [x[2] + stale for x in ranges[:1]])
            state.setTimeoutTimestamp(max(wake // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["conn_id", "start", "end", "last_ns"])

    return run


def stuck_heads(segments: DataFrame, timeout_ms: int = 1000, delay: str = "1 second") -> DataFrame:
    """Head ranges of byte streams that are given up. Segments (conn_id, seq, len, ts_ns) of a connection are fused as they come; the lowest
    range is its head, and if it does not grow for timeout_ms of event time it is dropped, the next one becomes the head, and
    bytes below the dropped end count no more. A row for each dropped range: conn_id, start, end, last_ns (its last growth)."""
    rows = segments.withColumn("at", event_time("ts_ns")).withWatermark("at", delay).select("conn_id", "seq", "len", "ts_ns", "at")
    return rows.groupBy("conn_id").applyInPandasWithState(_heads(timeout_ms), "conn_id long, start long, end long, last_ns long", _RANGES_STATE, "append", GroupStateTimeout.EventTimeTimeout)


_OPEN_STATE = "open binary"


def _closing(grace_ms: int, idle_ms: int):
    names = ["conn_id", "_null", "start_ns", "last_ns", "bytes", "closed"]

    def run(lane: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now_ms, new = state.getCurrentWatermarkMs(), [] if state.hasTimedOut else _came(pdfs, names, 6)
        known = _table(state.get[0] if state.exists else None, 6)
        both = pd.DataFrame(np.concatenate([known, *new], axis=1).T, columns=names)
        both["fresh"] = np.arange(len(both)) >= known.shape[1]
        rows = both.groupby(names[:2], as_index=False).agg(start_ns=("start_ns", "min"), last_ns=("last_ns", "max"), bytes=("bytes", "sum"), closed=("closed", "max"), fresh=("fresh", "max"))
        due = rows.last_ns // 1_000_000 + np.where(rows.closed > 0, grace_ms, idle_ms)
        # any call lets go of what is over, as a part that rows keep coming to has no timers; a connection with rows of this call stays for one more
        over = (due < now_ms) & ~rows.fresh.astype(bool)
        rows = rows[names]
        left = ~over
        if left.any():
            state.update((rows[left].to_numpy(dtype=np.int64).T.tobytes(),))
            state.setTimeoutTimestamp(max(int(due[left].min()), now_ms + 1))
        elif state.exists:
            state.remove()
        yield rows[over][names[:5]]

    return run


def closed_connections(events: DataFrame, grace_ms: int = 100, idle_ms: int = 15_000, delay: str = "1 second", lanes: int = LANES) -> DataFrame:
    """A row for each connection once it is over: grace_ms of event time after its last event if it was closed, else idle_ms. What is still
    open stays in the state, one for each of `lanes` parts of connections. events(conn_id, ts_ns, byte_size, closes); an event without a time is left out."""
    number = lambda name, x: x.cast("long").alias(name)
    rows = events.where("ts_ns is not null").withColumn("at", event_time("ts_ns")).withWatermark("at", delay)
    rows = rows.select(number("conn_id", F.coalesce(c("conn_id").cast("long"), F.lit(0))), number("_null", c("conn_id").isNull()), number("start_ns", c("ts_ns")), number("last_ns", c("ts_ns")),
                       number("bytes", F.coalesce(c("byte_size").cast("long"), F.lit(0))), number("closed", F.coalesce("closes", F.lit(False))), "at")
    out = dealt(rows, ("conn_id", "_null"), lanes).applyInPandasWithState(_closing(grace_ms, idle_ms), "conn_id long, _null long, start_ns long, last_ns long, bytes long", _OPEN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.when(c("_null") == 0, c("conn_id")).alias("conn_id"), "start_ns", "last_ns", "bytes")


def stale_heads(progress: DataFrame, timeout_ms: int = 1000, delay: str = "1 second") -> DataFrame:
    """Streams whose head range made no progress for timeout_ms of event time: their head is given up. progress(conn_id, ts_ns, byte_size)."""
    return closed_connections(progress.withColumn("closes", F.lit(False)), timeout_ms, timeout_ms, delay)
