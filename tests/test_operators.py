"""Operators on hand-made tables."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from netlens.functions import histogram, names, scalars
from netlens.operators import annotate, connections, enrich, filters, hops, pairing, ranges, reassembly, stats
from netlens.operators.filters import RecordFilter

MESSAGE = "conn_id long, is_req boolean, ts_ns long, seq long, byte_size long, stream_id long, corr_id long"


def messages(rows, requests, responses, stream=0):
    data = [(1, True, t, i, 1, stream, 0) for i, t in enumerate(requests)] + [(1, False, t, 1000 + i, 1, stream, 0) for i, t in enumerate(responses)]
    return rows(data, MESSAGE)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("requests, responses, pairs", [([1, 3], [2, 4], [(1, 2), (3, 4)]), ([1, 2], [3], [(2, 3)]), ([5], [2, 6], [(5, 6)]), ([3], [3], []), ([1], [2, 3], [(1, 2)])])
def test_fifo(rows, requests, responses, pairs):
    assert got(pairing.pair_fifo(messages(rows, requests, responses)), "req_ts", "resp_ts") == pairs


def test_fifo_against_a_loop(rows):
    rng, data, want = random.Random(5), [], []
    for conn in range(60):
        line = sorted((rng.randint(0, 12), rng.random() < 0.5, i) for i in range(12))
        line.sort(key=lambda x: (x[0], x[1], x[2]))
        pending = None
        for t, is_req, i in line:
            data.append((conn, is_req, t, i, 1, 0, 0))
            if is_req:
                pending = i
            else:
                if pending is not None:
                    want.append((conn, pending, i))
                pending = None
    assert got(pairing.pair_fifo(rows(data, MESSAGE)), "conn_id", "req_seq", "resp_seq") == sorted(want)


def test_queued_against_a_loop(rows):
    rng, data, want = random.Random(6), [], []
    for conn in range(60):
        line = [(rng.randint(0, 10), rng.random() < 0.5, i) for i in range(10)]
        line.sort(key=lambda x: (x[0], not x[1], x[2]))
        queue = []
        for t, is_req, i in line:
            data.append((conn, is_req, t, i, 1, 3, 0))
            if is_req:
                queue.append(i)
            elif queue:
                want.append((conn, queue.pop(0), i))
    assert got(pairing.pair_queued(rows(data, MESSAGE)), "conn_id", "req_seq", "resp_seq") == sorted(want)


def test_stream_pairing(rows):
    data = []
    for stream, req, resp in ((1, (0, 6), (1, 7)), (3, (2, 8), (3, 9, 13)), (5, (4, 10, 12), (5, 11))):
        data += [(1, True, t, t, 1, stream, 0) for t in req] + [(1, False, t, t, 1, stream, 0) for t in resp]
    m = rows(data, MESSAGE)
    pairs = pairing.pair_by_stream(m)
    assert got(pairs, "req_ts", "resp_ts") == [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11)]
    assert got(pairing.unmatched(m, pairs), "requests", "responses") == [(1, 1)]


def test_correlation(rows):
    assert pairing.pair_by_correlation(messages(rows, [1], [])).count() == 0
    assert pairing.pair_by_correlation(messages(rows, [1], [2])).count() == 1
    assert got(pairing.pair_by_opaque(messages(rows, [1, 5], [2, 3])), "req_ts", "resp_ts") == [(5, 2)]


def test_chains(rows):
    frames = rows([(1, 6, 5, True, 8, "response"), (1, 7, 6, True, 5, "frame"), (1, 8, 7, False, 4, "body"), (1, 20, 9, False, 1, "lone")], "conn_id long, request_id long, response_to long, more_to_come boolean, byte_size long, body string")
    assert got(pairing.stitch_chains(frames), "head_id", "frames", "byte_size", "body") == [(6, 3, 17, "response frame body "), (20, 1, 1, "lone ")]


def test_long_chains(rows):
    schema = "conn_id long, request_id long, response_to long, more_to_come boolean, byte_size long, body string"
    data = [(1, k, k - 1, k < 249, 1, str(k)) for k in range(250)] + [(2, 1, 2, True, 1, "round"), (2, 2, 1, True, 1, "round"), (None, 5, None, True, 1, "alone")]
    random.Random(4).shuffle(data)
    out = pairing.stitch_chains(rows(data, schema)).orderBy("head_id").collect()
    assert [(r.conn_id, r.head_id, r.frames, r.byte_size) for r in out] == [(1, 0, 250, 250), (None, 5, 1, 1)]
    assert out[0].body == "".join(f"{k} " for k in range(250))


def test_numbers_of_all_rows_in_parts(spark):
    out = stats.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5), "x")
    assert [(r.x, r.no) for r in out.orderBy("x").collect()] == [(k, k + 1) for k in range(1000)]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(_range" in plan and "windowspecdefinition(x" not in plan


def test_statements(rows):
    data = [(1, 7, 1, 1, "prepare", "select ?", None), (1, 7, 2, 2, "execute", None, ["a", "b"]), (1, 7, 3, 3, "close", None, None), (1, 7, 4, 4, "execute", None, ["c"])]
    out = pairing.join_statements(rows(data, "conn_id long, stmt_id long, ts_ns long, seq long, command string, body string, params array<string>"))
    assert got(out, "seq", "text") == [(2, "query=[select ?] params=[a, b]"), (4, "Execute stmt_id=7.")]


@pytest.mark.parametrize("values, expected", [([108.59, 45.89, 26.60], (64.0, 128.0, 128.0)), ([11.56], (16.0, 16.0, 16.0)), ([11.98, 10.0, 9.0], (13.33, 16.0, 16.0)), ([], (0.0, 0.0, 0.0)), ([5000.0, 9000.0], (8192.0, 8192.0, 8192.0)), ([16.0], (16.0, 16.0, 16.0)), ([0.5, 0.7], (0.5, 1.0, 1.0))])
def test_histogram_percentiles(rows, values, expected):
    df = histogram.cumulated(rows([(float(v),) for v in values], "v double").agg(*histogram.counters(F.col("v"))))
    assert tuple(round(x, 2) for x in df.select(*[histogram.percentile(p) for p in (50, 90, 99)]).first()) == expected


HTTP = "record_id long, protocol int, http struct<method:string,path:string,host:string>"


@pytest.mark.parametrize("options, request_, keep", [
    ({"http_path": "/foo/bar"}, (8, None), False), ({"http_path": "/foo/bar"}, (2, ("GET", "/foo/bar", "h")), True), ({"http_path": "/foo/bar"}, (2, ("GET", "/foo/bar/baz", "h")), False),
    ({"http_path_prefix": "/foo/bar"}, (2, ("GET", "/foo/bar/baz", "h")), True), ({"http_path_prefix": "/foo/bar"}, (2, ("GET", "/test", "h")), False),
    ({"http_path_regex": r"/foo/bar/\d+/baz"}, (2, ("GET", "/foo/bar/100/baz", "h")), True), ({"http_path_regex": r"/foo/bar/\w+"}, (2, ("GET", "/test", "h")), False),
    ({}, (2, ("POST", "/test", "test.com")), True), ({"http_methods": ["GET"]}, (2, ("GET", "/", "h")), True), ({"http_methods": ["GET"]}, (2, ("POST", "/", "h")), False),
    ({"http_host": "foo.bar"}, (2, ("GET", "/", "foo.bar")), True), ({"http_host": "foo.bar"}, (2, ("GET", "/", "foo.baz")), False)])
def test_http_filter(rows, options, request_, keep):
    assert (RecordFilter(**options).apply(rows([(1, *request_)], HTTP)).count() == 1) == keep


def test_filters_keep_no_nulls(rows):
    r = rows([(1, 7, None), (2, 7, (1, ["a.b"])), (3, 7, (1, None))], "record_id long, protocol int, dns struct<txid:int,names:array<string>>")
    assert got(RecordFilter(dns_host="a").apply(r), "record_id") == [(2,)]
    k = rows([(1, 0, ["t"], ["u"]), (2, 1, ["t"], ["u"]), (3, 3, ["t"], ["t"])], "record_id long, api_key int, q array<string>, r array<string>").select("record_id", F.lit(11).alias("protocol"), F.struct("api_key", F.col("q").alias("req_topics"), F.col("r").alias("resp_topics")).alias("kafka"))
    assert got(RecordFilter(kafka_topic="t").apply(k), "record_id") == [(1,)]
    assert got(RecordFilter(kafka_topic="t", kafka_producer=False).apply(k), "record_id") == []


@pytest.mark.parametrize("event, hit", [((5, 5), False), ((5, 6), True), ((12, 3), True), ((19, 11), True), ((20, 5), False), ((0, 40), True), ((12, 0), False)])
def test_overlap(rows, event, hit):
    e = rows([(1, *event)], "conn_id long, seq long, len long")
    r = rows([(1, 10, 20)], "conn_id long, start long, end long")
    assert ranges.overlap_join(e, r).count() == int(hit)


def test_overlap_of_all_lengths(rows):
    """Lengths from one byte to a gibibyte on either side."""
    rng = random.Random(8)
    one = lambda: (rng.randrange(1 << 30), 1 << rng.randrange(31))
    ev, ra = [(1, *one()) for _ in range(120)], [(1, *one()) for _ in range(120)]
    found = ranges.overlap_join(rows(ev, "conn_id long, seq long, len long"), rows([(k, s, s + n) for k, s, n in ra], "conn_id long, start long, end long"))
    assert found.count() == sum(s < t + m and s + n > t for _, s, n in ev for _, t, m in ra)


@pytest.mark.parametrize("long_events, long_ranges", [(3, 3), (4, 0), (0, 4), (0, 0)])
def test_overlap_of_few_long_ones(rows, long_events, long_ranges):
    """Short rows, and up to one in a hundred that is thousands to millions of times as long: those have bins of their own."""
    rng = random.Random(9)
    short = lambda n: [(k % 3, rng.randrange(20_000), rng.randint(1, 40)) for k in range(n)]
    long = lambda n: [(k % 3, rng.randrange(10_000) - (5 << 4 * k), 3000 << 4 * k) for k in range(n)]
    ev, ra = short(500) + long(long_events), short(400) + long(long_ranges)
    e, r = rows(ev, "conn_id long, seq long, len long"), rows([(k, s, s + n) for k, s, n in ra], "conn_id long, start long, end long")
    usual, of_e, of_r = ranges._size_classes(e, r)
    assert usual <= 9 and (len(of_e), len(of_r)) == (1 + long_events, 1 + long_ranges)
    want = sorted((k, s, n, t, t + m) for k, s, n in ev for j, t, m in ra if j == k and s < t + m and s + n > t)
    assert sorted(map(tuple, ranges.overlap_join(e, r).select("conn_id", "seq", "len", "start", "end").collect())) == want


SEG = "conn_id long, direction string, arrival long, seq long, payload binary"


@pytest.mark.parametrize("segments, want", [
    ([(1, 1, [0, 1, 2, 3, 4]), (2, 10, [4, 5, 6, 7, 8])], [(1, [0, 1, 2, 3, 4]), (10, [4, 5, 6, 7, 8])]),
    ([(1, 6, [4, 5, 6, 7, 8]), (2, 1, [0, 1, 2, 3, 4])], [(1, [0, 1, 2, 3, 4, 4, 5, 6, 7, 8])]),
    ([(1, 1, [0, 1, 2, 3, 4]), (2, 3, [4, 5, 6, 7, 8])], [(1, [0, 1, 2, 3, 4, 7, 8])]),
    ([(1, 1, [4, 5, 6, 7, 8]), (2, 1, [0, 1, 2, 3, 4])], [(1, [4, 5, 6, 7, 8])]),
    ([(1, 1, [0, 1, 2, 3, 4]), (2, 11, [11, 12, 16, 71, 18]), (3, 5, [3, 4, 5, 6, 7, 80, 1])], [(1, [0, 1, 2, 3, 4, 4, 5, 6, 7, 80, 11, 12, 16, 71, 18])])])
def test_reassembly(rows, segments, want):
    s = rows([(1, "in", a, q, bytearray(p)) for a, q, p in segments], SEG)
    assert [(r.start, list(r.payload)) for r in reassembly.reassemble(s).orderBy("start").collect()] == want
    blocks = [(r.start, list(r.payload)) for r in reassembly.reassemble(s, block=4).orderBy("start").collect()]
    assert all(len(p) <= 4 and start // 4 == (start + len(p) - 1) // 4 for start, p in blocks)
    assert {start + k: v for start, p in blocks for k, v in enumerate(p)} == {start + k: v for start, p in want for k, v in enumerate(p)}


def test_reassembly_against_bytes(rows):
    rng, data, want = random.Random(8), [], {}
    for conn in range(30):
        held, seen = {}, set()
        for a in range(8):
            q, p = rng.randint(0, 40), [rng.randint(0, 255) for _ in range(rng.randint(1, 12))]
            data.append((conn, "in", a, q, bytearray(p)))
            if q not in seen:
                seen.add(q)
                for i, b in enumerate(p):
                    held.setdefault(q + i, b)
        want[conn] = sorted(held.items())
    out = {}
    for r in reassembly.reassemble(rows(data, SEG)).collect():
        out.setdefault(r.conn_id, []).extend((r.start + i, b) for i, b in enumerate(r.payload))
    assert {k: sorted(v) for k, v in out.items()} == want


def test_wrapped_sequence(rows):
    s = rows([(1, "in", 1, (1 << 32) - 5, 5), (1, "in", 2, 0, 5)], "conn_id long, direction string, arrival long, seq long, len long")
    assert got(reassembly.unwrapped(s), "seq64") == [((1 << 32) - 5,), (1 << 32,)]
    far = rows([(1, "in", 1, 0, 5), (1, "in", 2, 3 << 20, 5)], "conn_id long, direction string, arrival long, seq long, len long")
    assert got(reassembly.islands(far), "epoch", "start") == [(0, 0), (1, 3 << 20)]


def test_time_of_offset(rows):
    s = rows([(1, 1, 1, 2)], "conn_id long, seq long, arrival long, ts_ns long")

    assert dict(got(ranges.time_of_offset(rows([(1, 1)], "conn_id long, seq long"), s), "seq", "ts_ns")) == {1: 2}


def test_lookup(rows):
    ev = [(7, "connect", 10, 1), (7, "close", 20, 2), (7, "connect", 30, 3)]
    conns = connections.lifecycles(rows(ev, "tgid_fd long, kind string, ts_ns long, seq long"))
    found = connections.lookup(rows([(7, t) for t in (5, 10, 15, 20, 25, 30, 31)], "tgid_fd long, ts_ns long"), conns)
    assert got(found, "ts_ns", "start_ns") == [(10, 10), (15, 10), (20, 10), (31, 30)]


def test_annotation_of_both_sides(rows):
    pairs = rows([("c", 1, "client", 100, 900), ("s", 1, "server", 100, 900), ("x", 1, "client", 100, 900)], "conn_id string, pair_id long, side string, req_ts long, resp_ts long")
    ev = [("c", True, names.SYSCALL_OUT, 1, 110), ("c", True, names.DEV_OUT, 1, 120), ("c", False, names.NIC_IN, 1, 700), ("c", False, names.TCP_IN, 1, 710), ("c", False, names.USER_COPY, 1, 730), ("c", False, names.SYSCALL_IN, 1, 740),
          ("s", True, names.NIC_IN, 1, 210), ("s", True, names.TCP_IN, 1, 220), ("s", True, names.USER_COPY, 1, 240), ("s", True, names.SYSCALL_IN, 1, 250), ("s", False, names.SYSCALL_OUT, 1, 600), ("s", False, names.DEV_OUT, 1, 620)]
    events = rows([(k, 1, q, st, s, t) for k, q, st, s, t in ev], "conn_id string, pair_id long, is_req boolean, step int, seq long, ts_ns long").withColumns({"first_ns": F.col("ts_ns"), "last_ns": F.col("ts_ns")})
    out = {r.conn_id: (r.start_ns, r.end_ns, r.total_ns, r.black_box_ns, r.read_socket_ns, r.copy_to_sock_ns) for r in annotate.annotate(pairs, events).collect()}
    assert out["c"] == (110, 740, 630, 580, 20, 10)
    assert out["s"] == (210, 620, 410, 350, 20, 10)
    assert out["x"] == (100, 900, 800, None, None, None)


def test_containers(rows):
    data = [("a" * 64, "/web", '{"io.kubernetes.pod.name":"p.q","io.kubernetes.pod.namespace":"ns"}', 10, 1, 2, 3, ""), ("b" * 64, "/pause", '{"io.kubernetes.docker.type":"podsandbox"}', 11, 1, 2, 4, ""), ("c" * 64, "/bare", "{}", 12, 0, 0, 0, "")]
    from netlens.schemas import CONTAINER_SCHEMA
    from netlens.sources.readers import parsed_labels

    c = parsed_labels(rows(data, CONTAINER_SCHEMA))
    assert got(enrich.usable_containers(c), "name") == [("/web",)]
    assert got(enrich.choose_containers(c, pod="p.q.ns"), "container") == [("web",)]
    assert enrich.choose_containers(c, container_id="a" * 12).count() == 1
    assert enrich.choose_containers(c, container_id="a" * 11).count() == 0
    tree = rows([(1, None), (2, 1), (3, 2), (4, 1), (9, 8)], "pid long, ppid long")
    assert got(enrich.descendants(tree, rows([(2,)], "pid long")), "pid") == [(2,), (3,)]


def test_deep_trees_and_circles(rows):
    """A chain of 299 processes, and a circle of parents that no root is above."""
    tree = rows([(k + 1, k) for k in range(1, 300)] + [(1001, 1002), (1002, 1003), (1003, 1001), (2001, 2002), (2002, 2001)], "pid long, ppid long")
    assert got(enrich.descendants(tree, rows([(1,), (2002,)], "pid long")), "pid") == [(k,) for k in range(1, 301)] + [(2001,), (2002,)]


@pytest.mark.parametrize("side", ["client", "server"])
@pytest.mark.parametrize("ssl", [None, (True, True), (False, True), (True, False)])
@pytest.mark.parametrize("flags", [(True, True), (False, True), (True, False)])
def test_annotation_matrix(rows, side, ssl, flags):
    """Side, TLS and trace flags: every event is there, each lasts 5 longer than it begins, and interfaces differ by 3."""
    into, out = side == "server", side != "server"
    at = {names.SYSCALL_OUT: 100, names.DEV_OUT: 120, names.NIC_IN: 20, names.TCP_IN: 30, names.USER_COPY: 50, names.SYSCALL_IN: 60}
    if side == "client":
        at = {names.SYSCALL_OUT: 10, names.DEV_OUT: 15, names.NIC_IN: 70, names.TCP_IN: 80, names.USER_COPY: 95, names.SYSCALL_IN: 90}
    ev = [(1, 1, into if s in (names.NIC_IN, names.TCP_IN, names.USER_COPY, names.SYSCALL_IN) else out, s, n, t + 2 * n, 5, t + 2 * n - 3, t + 2 * n + 3) for s, t in at.items() for n in (0, 1)]
    events = rows(ev, "conn_id long, pair_id long, is_req boolean, step int, seq long, ts_ns long, ts_delta long, first_ns long, last_ns long")
    req_maps, resp_maps = ssl or (None, None)
    pairs = rows([(1, 1, side, ssl is not None, req_maps, resp_maps, 1, 200)], "conn_id long, pair_id long, side string, is_ssl boolean, req_maps boolean, resp_maps boolean, req_ts long, resp_ts long")
    r = annotate.annotate(pairs, events, trace_devices=flags[0], trace_sockets=flags[1]).first()
    read, write = (req_maps is not False, resp_maps is not False) if side == "server" else (resp_maps is not False, req_maps is not False)
    w0, w1, dev1, nic0, nic1, tcp0, tcp1, copy1, read0, read1 = (at[s] + 2 * n for s, n in ((names.SYSCALL_OUT, 0), (names.SYSCALL_OUT, 1), (names.DEV_OUT, 1), (names.NIC_IN, 0), (names.NIC_IN, 1), (names.TCP_IN, 0), (names.TCP_IN, 1), (names.USER_COPY, 1), (names.SYSCALL_IN, 0), (names.SYSCALL_IN, 1)))
    dev, sock = flags
    if side == "server":
        start, end = nic0 - 3 if dev else tcp0, dev1 + 3 if dev else w1 + 5
        box = w1 + 5 - read0 if read and write else 199
        total = box if not dev else end - start if read and write else None
        socket = copy1 - tcp0 if read else None
        copied = tcp1 - nic0 if write and dev and sock else None
    else:
        start, end = w0 if write else 1, read1 + 5 if read else 200
        total = end - start if read and write else 199
        box = nic1 - 3 - (at[names.DEV_OUT] + 3) if read and write and dev else None
        socket = copy1 - tcp0 if read else None
        copied = tcp1 - nic0 if read and dev and sock else None
    if not sock:
        socket = read1 + 5 - (nic0 - 3) if read else None
    assert (r.start_ns, r.end_ns, r.total_ns, r.black_box_ns, r.read_socket_ns, r.copy_to_sock_ns) == (start, end, total, box, socket, copied)


def test_lookup_at_the_start_of_the_newest(rows):
    """An event at the very start of the newest connection belongs to the one before it, if that one covers it."""
    conns = rows([(7, 10, 30, None), (7, 30, None, None), (8, 10, 30, 20), (8, 30, None, None), (9, 5, None, None)], "tgid_fd long, start_ns long, next_ns long, close_ns long")
    found = connections.lookup(rows([(7, 30), (8, 30), (8, 20), (9, 5), (9, 6)], "tgid_fd long, ts_ns long"), conns)
    assert got(found, "tgid_fd", "ts_ns", "start_ns") == [(7, 30, 10), (8, 20, 10), (9, 6, 5)]


def test_hops(rows):
    r = rows([(1, "out", 100, {"time-eth0": 150, "time-lo": 120})], "record_id long, direction string, start_ns long, attributes map<string,bigint>")
    assert got(hops.hops(r), "hop", "ifname", "used_ns") == [(1, "lo", 20), (2, "eth0", 30)]


def test_texts(rows):
    out = rows([("äbcdef", bytearray([10, 0, 0, 255]), bytearray(range(16)))], "t string, v4 binary, v6 binary").select(scalars.truncated(F.col("t"), 4), scalars.ip_text(F.col("v4")), scalars.ip_text(F.col("v6")), scalars.displayed(F.lit(None)), scalars.rfc3339_nano(F.lit(1_704_067_207_000_000_000)), scalars.rfc3339_nano(F.lit(1_704_067_207_179_575_010))).first()
    assert tuple(out) == ("äbc...(truncated, total: 7bytes)", "10.0.0.255", "1:203:405:607:809:a0b:c0d:e0f", "-", "2024-01-01T00:00:07Z", "2024-01-01T00:00:07.17957501Z")


def test_redis_text(rows):
    texts = ["*3\r\n$3\r\nset\r\n$1\r\na\r\n$1\r\nb\r\n", "*2\r\n$6\r\nclient\r\n$4\r\nlist\r\n", "-ERR x\r\n", "+OK\r\n"]
    out = [tuple(r.r) for r in rows([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(scalars.redis_fields(F.col("t")).alias("r")).collect()]
    assert out == [("SET", "a b", False), ("CLIENT LIST", "", False), (None, "ERR x", True), (None, "OK", False)]


def test_tls_mapping(rows):
    ssl = rows([(1, 0, 10, 0, 30), (1, 10, 10, 530, 30), (2, 0, 10, 100, 0)], "conn_id long, seq long, len long, syscall_seq long, syscall_len long")
    m = rows([(1, 0, 20), (2, 0, 10)], "conn_id long, start long, end long")
    assert got(ranges.map_tls(ssl, m), "conn_id", "kern_start", "kern_len", "valid") == [(1, 530, 30, True), (2, 100, 0, False)]


def test_empty_tables(rows):
    m = rows([], MESSAGE)
    for fn in (pairing.pair_fifo, pairing.pair_by_stream, pairing.pair_by_correlation, pairing.pair_by_opaque, pairing.pair_queued):
        assert fn(m).count() == 0
    assert filters.with_payload(rows([(0,), (1,)], "len long")).count() == 1
    assert stats.stat(rows([], "conn_id string, total_ns long, response_status int, side string")).count() == 0


def test_own_protocol(rows):
    from netlens.plans.protocols import MATCHERS, ProtocolSpec, register

    spec = register(ProtocolSpec("echo", 99, "fifo", {"slow": lambda: F.col("resp_ts") - F.col("req_ts") > 1}, [lambda: F.col("req_ts") > 0], lambda: F.lit("echo")))
    assert got(spec.pairs(messages(rows, [0, 3], [1, 5])), "req_ts", "protocol", "slow") == [(3, 99, True)]
    assert stats.CLASSIFIERS.pop("echo") and "fifo" in MATCHERS
    with pytest.raises(ValueError):
        register(ProtocolSpec("bad", 1, "guess"))


def test_addresses_as_text(spark):
    """Against the standard library, which folds in the same way."""
    rng = random.Random(12)
    raws = [bytes(16), bytes(15) + b"\1", b"\1" + bytes(15), bytes(10) + b"\xff\xff\x7f\0\0\1", bytes(4) + b"\1\2" + bytes(4) + b"\3\4" + bytes(4), bytes.fromhex("20010db8000000010000000000000001")]
    raws += [b"".join(rng.choice([b"\0\0", b"\0\0", b"\0\7", bytes([rng.randrange(256), rng.randrange(256)])]) for _ in range(8)) for _ in range(300)] + [bytes([10, 0, 0, 255])]
    got = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i long, raw binary").select("i", scalars.ip_text(F.col("raw")).alias("t")).collect()
    for r in got:
        a = ipaddress.ip_address(raws[r.i])
        assert r.t == str(getattr(a, "ipv4_mapped", None) or a)


def test_ipv6_text_of_a_made_up_column_is_compiled(spark):
    """Every place and length of zero groups, of bytes that are themselves a long expression, in one compiled stage."""
    import ipaddress

    raw = F.unhex(F.concat(*[F.when(F.expr(f"id & {1 << k} <> 0"), F.lpad(F.hex(F.col("id") * 7 % 65535 + 1), 4, "0")).otherwise(F.lit("0000")) for k in range(8)]))
    out = spark.range(256).select(F.hex(raw).alias("h"), scalars.ip_text(raw).alias("t"))
    for r in out.collect():
        address = ipaddress.IPv6Address(bytes.fromhex(r.h))
        assert r.t == (str(address.ipv4_mapped) if address.ipv4_mapped else str(address)), r.h
    fallback = "spark.sql.codegen.fallback"
    before = spark.conf.get(fallback)
    spark.conf.set(fallback, "false")
    try:
        assert spark.range(256).select(scalars.ip_text(raw).alias("t")).where("t like '%::%'").count() > 200
    finally:
        spark.conf.set(fallback, before)
