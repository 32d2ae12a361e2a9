"""Streaming operators with state, fed in several files, against batch operators and plain loops."""

import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netlens.operators import annotate as batch_annotate
from netlens.operators import reassembly as batch
from netlens.operators.ranges import overlap_join
from netlens.streaming import annotate, order, pairing, reassembly
from netlens.streaming.run import run_available

SECOND = 1_000_000_000


@pytest.fixture
def stream(spark):
    """Rows as a stream of files, one micro-batch for each part."""

    def made(parts, schema):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03d}.parquet")
        kind = spark.createDataFrame([], schema).schema
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")

    return made


SEGMENTS = "conn_id long, direction string, seq long, len long, ts_ns long, arrival long, closes boolean"
#: A row that lets the watermark pass all others; its own connection stays open.
LATER = (-1, "in", 1, 1, 10**9 * SECOND, 10**9, False)


def ranges_of(stream, rows, parts=1, **options):
    size = -(-len(rows) // parts)
    cut = [rows[k:k + size] for k in range(0, len(rows), size)] + [[LATER]]
    out = run_available(reassembly.ranges(stream(cut, SEGMENTS), **options), stateful=True).where("conn_id >= 0").collect()
    return sorted((r.conn_id, r.epoch, r.start, r.end, r.segments, r.bytes, r.reason) for r in out)


@pytest.mark.parametrize("parts", [1, 4])
def test_ranges_as_in_batch(spark, stream, parts):
    rng = random.Random(parts)
    rows = []
    for conn in range(6):
        base = (1 << 32) - 3000 if conn % 2 else 10
        at = list(range(70))
        for k in range(0, 70, 5):  # shuffled by fives; the wrap lies between two fives
            some = at[k:k + 5]
            rng.shuffle(some)
            at[k:k + 5] = some
        for n, k in enumerate(at):
            seq = (base + k * 100) % (1 << 32)
            rows.append((conn, "in", seq, rng.choice([40, 100, 100, 150]), (n + 1) * SECOND, n, False))
            if k % 9 == 0:
                rows.append((conn, "in", seq, 190, (n + 1) * SECOND, n + 1000, False))  # the same seq again
        rows.append((conn, "in", 0, 0, 80 * SECOND, 2000, True))
    rows.sort(key=lambda r: r[4])
    got = ranges_of(stream, rows, parts, stuck_ms=10**9)
    sized = spark.createDataFrame([r for r in rows if r[3]], SEGMENTS)
    order = F.row_number().over(Window.partitionBy("conn_id").orderBy("ts_ns", "arrival"))
    want = batch.wrapped_islands(sized.withColumn("arrival", order)).collect()
    assert [g[:6] for g in got] == sorted((r.conn_id, r.epoch, r.start, r.end, r.segments, r.bytes) for r in want)
    assert {g[6] for g in got} == {"wrap", "close"} and max(g[1] for g in got) == 1


def test_reasons(stream):
    mib, s = 1 << 20, SECOND
    rows = [
        # 1: the head is stuck after a second, the next range a second after its own growth; what comes below then is before the head
        (1, "in", 100, 50, 1 * s, 1, False), (1, "in", 200, 50, 1 * s + 900_000_000, 2, False), (1, "in", 120, 20, 2 * s + 500_000_000, 3, False), (1, "in", 260, 10, 5 * s, 4, False),
        # 2: a jump of a MiB; then a segment a MiB before the new head
        (2, "in", 10, 10, 1 * s, 1, False), (2, "in", 20 + mib + 5, 10, 1 * s + 1, 2, False), (2, "in", 12, 5, 1 * s + 2, 3, False), (2, "in", 0, 0, 1 * s + 3, 4, True),
        # 3: more than 1000 bytes: the oldest range goes, and nothing below its end comes back
        (3, "in", 0, 300, 1 * s, 1, False), (3, "in", 400, 300, 1 * s + 1, 2, False), (3, "in", 900, 300, 1 * s + 2, 3, False), (3, "in", 250, 100, 1 * s + 3, 4, False), (3, "in", 0, 0, 1 * s + 4, 5, True),
        # 4: a wrap, and a segment from before it
        (4, "in", (1 << 32) - 50, 50, 1 * s, 1, False), (4, "in", 0, 30, 1 * s + 1, 2, False), (4, "in", (1 << 32) - 90, 40, 1 * s + 2, 3, False), (4, "in", 0, 0, 1 * s + 3, 4, True),
        # 5: closed and used again
        (5, "in", 7, 3, 1 * s, 1, True), (5, "in", 3, 2, 1 * s + 1, 2, True),
    ]
    want = [
        (1, 0, 100, 150, 1, 50, "stuck"), (1, 0, 120, 140, 1, 20, "before head"), (1, 0, 200, 250, 1, 50, "stuck"), (1, 0, 260, 270, 1, 10, "stuck"),
        (2, 0, 10, 20, 1, 10, "gap"), (2, 1, 12, 17, 1, 5, "before head"), (2, 1, 25 + mib, 35 + mib, 1, 10, "close"),
        (3, 0, 0, 300, 1, 300, "capacity"), (3, 0, 300, 350, 1, 100, "close"), (3, 0, 400, 700, 1, 300, "close"), (3, 0, 900, 1200, 1, 300, "close"),
        (4, 0, (1 << 32) - 50, 1 << 32, 1, 50, "wrap"), (4, 1, 0, 30, 1, 30, "close"), (4, 1, (1 << 32) - 90, (1 << 32) - 50, 1, 40, "before head"),
        (5, 0, 3, 5, 1, 2, "close"), (5, 0, 7, 10, 1, 3, "close"),
    ]
    rows.sort(key=lambda r: r[4])
    for parts in (1, 5):
        assert ranges_of(stream, rows, parts, capacity=1000) == sorted(want)


TIMELINE = ", ".join(f"{k} {t}" for k, t in annotate.TIMELINE.items())


def timeline_row(**made):
    return tuple(made.get(k) for k in annotate.TIMELINE)


def packet(conn, ts, step, seq, size=10, delta=3, nic="eth0"):
    return timeline_row(conn_id=conn, ts_ns=ts, kind="packet", step=step, seq=seq, len=size, ts_delta=delta, ifname=nic)


def a_pair(conn, ts, pair, side, req, resp, ssl=False):
    return timeline_row(conn_id=conn, ts_ns=ts, kind="pair", pair_id=pair, side=side, is_ssl=ssl, req_ts=ts - 900, req_start=req[0], req_end=req[1], resp_start=resp[0], resp_end=resp[1])


LATER_PACKET = packet(-1, 10**9 * SECOND, 2, 0)
MEASURES = ["conn_id", "pair_id", "start_ns", "end_ns", "total_ns", "black_box_ns", "read_socket_ns", "copy_to_sock_ns"]


def annotated(stream, rows, parts=1, **options):
    size = -(-len(rows) // parts)
    cut = [rows[k:k + size] for k in range(0, len(rows), size)] + [[LATER_PACKET]]
    return run_available(annotate.annotated(stream(cut, TIMELINE), **options), stateful=True).where("conn_id >= 0")


@pytest.mark.parametrize("parts", [1, 3])
def test_annotation_as_in_batch(spark, stream, parts):
    """Random packets of 40 pairs, none late: the rows of the range join and the batch rules."""
    rng, rows, pairs, at = random.Random(parts), [], [], 0
    for n in range(40):
        conn, m = n % 4, n // 4
        seen = set()
        for _ in range(30):
            at += 1_000_000
            step, seq = rng.choice([2, 6, 8, 9, 11, 12, 13]), m * 1000 + rng.randint(0, 890)
            if (step, seq) not in seen:
                seen.add((step, seq))
                rows.append(packet(conn, at, step, seq, rng.randint(1, 100), rng.randint(0, 50)))
        at += 1_000_000
        pairs.append((conn, m, "client" if conn % 2 else "server", at - 900, at, m * 1000, m * 1000 + 500, m * 1000 + 300, m * 1000 + 990))
        rows.append(a_pair(conn, at, m, pairs[-1][2], pairs[-1][5:7], pairs[-1][7:9]))
        at += 2 * SECOND
    got = sorted(map(tuple, annotated(stream, rows, parts).select(*MEASURES).collect()))
    p = spark.createDataFrame(pairs, "conn_id long, pair_id long, side string, req_ts long, resp_ts long, q0 long, q1 long, r0 long, r1 long")
    kern = spark.createDataFrame([r for r in rows if r[2] == "packet"], TIMELINE).select("conn_id", "step", "seq", "len", "ts_ns", "ts_delta", F.col("ts_ns").alias("first_ns"), F.col("ts_ns").alias("last_ns"))
    events = None
    for is_req, a, b in ((True, "q0", "q1"), (False, "r0", "r1")):
        hit = overlap_join(kern, p.select("conn_id", "pair_id", "side", F.col(a).alias("start"), F.col(b).alias("end"))).withColumn("is_req", F.lit(is_req))
        hit = hit.where((F.col("step") <= 7) == ((F.col("side") == "client") == F.col("is_req"))).drop("side", "start", "end")
        events = hit if events is None else events.unionByName(hit)
    want = batch_annotate.annotate(p, events).select(*MEASURES).collect()
    assert got == sorted(map(tuple, want)) and len(got) == 40 and sum(r[5] is not None for r in got) > 20


def test_consumed_bytes_are_done_with(stream):
    """Events below the mark give nothing, whether they wait or come late; those at the mark belong to the next pair."""
    s = SECOND
    rows = [packet(1, 1 * s, 2, 10), packet(1, 1 * s + 1, 13, 20), a_pair(1, 1 * s + 5, 0, "client", (0, 50), (0, 60)),
            packet(1, 3 * s, 2, 49), packet(1, 3 * s + 1, 2, 50), packet(1, 3 * s + 2, 13, 59), packet(1, 3 * s + 3, 13, 70), a_pair(1, 3 * s + 5, 1, "client", (0, 90), (0, 90)),
            # the second copy of an event, and a second interface of a card
            packet(2, 1 * s, 13, 5), packet(2, 1 * s + 7, 13, 5), packet(2, 1 * s + 8, 8, 5, nic="eth0"), packet(2, 1 * s + 9, 8, 5, nic="eth1"), a_pair(2, 1 * s + 10, 0, "server", (0, 9), (0, 9))]
    for parts in (1, 2):
        out = {(r.conn_id, r.pair_id): sorted((e.step, e.seq, e.first_ns, e.last_ns) for e in r.events) for r in annotated(stream, rows, parts).collect()}
        assert out == {(1, 0): [(2, 10, s, s), (13, 20, s + 1, s + 1)], (1, 1): [(2, 50, 3 * s + 1, 3 * s + 1), (13, 70, 3 * s + 3, 3 * s + 3)],
                       (2, 0): [(8, 5, s + 8, s + 9), (13, 5, s, s)]}


def test_idle_connections_are_forgotten(stream):
    s = SECOND
    rows = [packet(1, 1 * s, 2, 10), a_pair(1, 1 * s + 5, 0, "client", (0, 50), (0, 60)), packet(1, 100 * s, 2, 20), a_pair(1, 100 * s + 5, 1, "client", (0, 50), (0, 60))]
    count = lambda **o: {r.pair_id: len(r.events) for r in annotated(stream, rows, **o).collect()}
    assert count() == {0: 1, 1: 0} and count(idle_ms=60_000) == {0: 1, 1: 1}


def test_records_leave_in_request_order(spark, stream):
    """Out of order inside and between batches, within the delay; numbers go on from batch to batch."""
    rng = random.Random(6)
    at = [(k * SECOND // 2 + rng.randint(0, 4 * SECOND), k) for k in range(300)]
    rows = [(t, k, f"r{k % 7}" if k % 11 else None) for t, k in at]
    parts = [rows[k:k + 60] for k in range(0, 300, 60)] + [[(10**6 * SECOND, -1, "end")]]
    df = stream(parts, "start_ns long, record_id long, request string")
    got = run_available(order.in_request_order(df.withColumn("lane", F.when(F.col("record_id") < 0, -1).otherwise(F.col("record_id") % 3)), ["record_id", "request"], lane="lane", delay="10 seconds"), stateful=True)
    out = {}
    for r in got.where("lane >= 0").collect():
        out.setdefault(r.lane, []).append((r.position, r.start_ns, r.record_id, r.request))
    for lane in range(3):
        want = sorted((t, k, x) for t, k, x in rows if k % 3 == lane)
        assert sorted(out[lane]) == [(i, *w) for i, w in enumerate(want)]


def test_a_long_queue_loses_nothing(spark, stream):
    s, n = SECOND, 1500
    rows = [(1, s + i * s // 100, i, True) for i in range(n)] + [(1, 100 * s + i * s // 100, n + i, False) for i in range(n)]
    df = stream([rows[:1000], rows[1000:1700], rows[1700:], [(2, 10**6 * s, 10**6, True)]], "conn_id long, ts_ns long, seq long, is_req boolean")
    out = run_available(pairing.pair(df, "queued", ("conn_id",))).collect()
    assert sorted((r.req_seq, r.resp_seq) for r in out) == [(i, n + i) for i in range(n)]


@pytest.mark.parametrize("lanes", [1, 3])
def test_many_keys_share_a_lane(stream, lanes):
    """Keys of a lane do not mix, null keys are keys of their own, and numbers beyond a double's stay exact beside null ones; what is as late
    as the last watermark counts."""
    rng, big, rows = random.Random(8), (1 << 60) + 1, []
    for n in range(600):
        key = rng.choice([None, 0, *range(-3, 40)]), rng.choice([None, 0, 1])
        rows.append((*key, (n + 1) * SECOND, None if n % 50 == 7 else big + n, rng.random() < 0.5))
    rows[-1] = (5, 1, 600 * SECOND, big + 600, False)
    rows[-2] = (5, 1, 599 * SECOND, big + 599, True)
    df = stream([rows[:200], rows[200:], [(99, 9, 601 * SECOND, 1, True)]], "conn_id long, corr_id long, ts_ns long, seq long, is_req boolean")
    got = {rule: {tuple(r) for r in run_available(pairing.pair(df, rule, ("conn_id", "corr_id"), keep_ms=10**9, lanes=lanes)).collect()} for rule in ("queued", "opaque")}
    want, waiting = {"queued": set(), "opaque": set()}, {"queued": {}, "opaque": {}}
    for a, b, t, s, is_req in rows:
        for rule, queues in waiting.items():
            q = queues.setdefault((a, b), [])
            if is_req:
                q[:] = [*(q if rule == "queued" else []), (t, s)]
            elif q:
                first = q.pop(0)
                want[rule].add((a, b, first[0], t, first[1], s))
    assert got == want and any(r[0] is None for r in got["queued"])


def test_connections_close_while_others_of_their_lane_go_on(stream):
    """A close is remembered over batches, and a connection that is over leaves although its lane has rows in every batch."""
    s = SECOND
    parts = [[(1, 1 * s, 10, True), (2, 1 * s, 5, False), (None, 1 * s, 3, False)], [(1, 1 * s + 50_000_000, 1, False), (3, 10 * s, 1, False)], *([(3, t * s, 1, False)] for t in (12, 13, 14))]
    df = stream(parts, "conn_id long, ts_ns long, byte_size long, closes boolean")
    out = run_available(pairing.closed_connections(df, lanes=1)).collect()
    assert [tuple(r) for r in out] == [(1, s, s + 50_000_000, 11)]
    out = run_available(pairing.closed_connections(df, idle_ms=5000, lanes=1)).collect()
    assert {tuple(r) for r in out} == {(1, s, s + 50_000_000, 11), (2, s, s, 5), (None, s, s, 3)}


@pytest.mark.parametrize("lanes", [1, 3])
def test_streams_share_a_part(stream, lanes):
    """Many streams in few parts: they do not mix, those without rows in a batch are kept or let go in time, null keys are keys of their own."""
    conns = [None, *range(30)]
    rows = [(conn, None if conn == 3 else "in", 100 * k, 100, (10 * k + i + 1) * SECOND, k, k == 3 and conn != 7) for i, conn in enumerate(conns) for k in range(4)]
    rows.sort(key=lambda r: r[4])
    df = stream([rows[:50], rows[50:90], rows[90:], [LATER]], SEGMENTS)
    out = run_available(reassembly.ranges(df, stuck_ms=10**6, lanes=lanes), stateful=True).where("conn_id is null or conn_id >= 0").collect()
    assert sorted(((r.conn_id is None, r.conn_id or 0), r.direction, r.start, r.end, r.segments, r.reason) for r in out) == sorted(
        ((conn is None, conn or 0), None if conn == 3 else "in", 0, 400, 4, "stuck" if conn == 7 else "close") for conn in conns)


def test_a_lane_is_not_held_by_python(spark, stream):
    """Order is Spark's own: no lane is handed to one Python call. Equal records have a position each, a null lane is a lane."""
    rows = [((k % 50 + 1) * SECOND, k // 100, "r") for k in range(300)]
    df = stream([rows[:100], rows[100:], [(10**6 * SECOND, -1, "end")]], "start_ns long, record_id long, request string").withColumn("lane", F.when(F.col("record_id") != 1, F.col("record_id")))
    made = order.in_request_order(df, ["request"], lane="lane", delay="60 seconds")
    got = run_available(made, stateful=True).where("lane is null or lane >= 0").collect()
    assert sorted(((r.lane is None, r.lane or 0), r.position, r.start_ns) for r in got) == sorted(((n == 1, 0 if n == 1 else n), i, (i // 2 + 1) * SECOND) for n in range(3) for i in range(100))
    plan = made.stream._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    assert "Python" not in plan and "Pandas" not in plan
