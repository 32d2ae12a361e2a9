"""Queries over messages, packet events, connections and dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netlens.functions import names
from netlens.operators import annotate, connections, enrich, filters, hops, inference, lifetimes, pairing, ranges, reassembly, timeline
from netlens.operators.scratch import parts_of, scratch_path
from netlens.plans.oracle import CONN_EVENTS, CONTAINERS, EVENTS, KERN, MESSAGES, PROCESSES, RECORDS, SEGMENTS
from netlens.plans.protocols import PROTOCOLS
from netlens.plans.registry import query
from netlens.schemas import FAMILIES
from netlens.sources import adapters, readers

c = F.col

# --- pairs -----------------------------------------------------------------------------------------------------------------


def _lag_sql(keys: str, tie: str) -> str:
    first = "CASE WHEN is_req THEN 1 ELSE 0 END" if tie == "response" else "CASE WHEN is_req THEN 0 ELSE 1 END"
    return (f"SELECT {keys}, req_ts, ts_ns AS resp_ts, req_seq, seq AS resp_seq, req_size, byte_size AS resp_size FROM (SELECT *, lag(is_req) OVER w AS was, lag(ts_ns) OVER w AS req_ts, lag(seq) OVER w AS req_seq, lag(byte_size) OVER w AS req_size "
            f"FROM messages WINDOW w AS (PARTITION BY {keys} ORDER BY ts_ns, {first}, seq)) WHERE NOT is_req AND was")


@query("d1_pair_fifo", _lag_sql("conn_id", "response"), (MESSAGES,))
def d1(spark, sf):
    return pairing.pair_fifo(adapters.messages(spark, sf))


@query("d5_pair_by_stream", _lag_sql("conn_id, stream_id", "request"), (MESSAGES,))
def d5(spark, sf):
    return pairing.pair_by_stream(adapters.messages(spark, sf))


@query("d1_pair_fifo_long", _lag_sql("conn_id", "response").replace("FROM messages", "FROM (SELECT * REPLACE (conn_id % 2 AS conn_id) FROM messages)"), (MESSAGES,))
def d1_long(spark, sf):
    """Two connections have all messages; each is cut into blocks."""
    return pairing.pair_fifo(adapters.messages(spark, sf).withColumn("conn_id", c("conn_id") % 2), blocks=16)


def _id_sql(req: str, resp: str, where: str = "") -> str:
    side = lambda is_req, order: f"(SELECT * FROM messages WHERE {is_req} QUALIFY row_number() OVER (PARTITION BY conn_id, corr_id ORDER BY ts_ns {order}, seq {order}) = 1)"
    return f"SELECT q.conn_id, q.corr_id, q.ts_ns AS req_ts, q.seq AS req_seq, q.byte_size AS req_size, r.ts_ns AS resp_ts, r.seq AS resp_seq, r.byte_size AS resp_size FROM {side('is_req', req)} q JOIN {side('NOT is_req', resp)} r ON q.conn_id = r.conn_id AND q.corr_id = r.corr_id {where}"


@query("d2_pair_by_correlation", _id_sql("", "DESC", "WHERE q.ts_ns <= r.ts_ns"), (MESSAGES,))
def d2(spark, sf):
    return pairing.pair_by_correlation(adapters.messages(spark, sf))


@query("d3_pair_by_opaque", _id_sql("DESC", ""), (MESSAGES,))
def d3(spark, sf):
    return pairing.pair_by_opaque(adapters.messages(spark, sf))


@query("d4_pair_queued", """SELECT q.conn_id, q.stream_id, q.ts_ns AS req_ts, q.seq AS req_seq, r.ts_ns AS resp_ts, r.seq AS resp_seq FROM
 (SELECT *, row_number() OVER (PARTITION BY conn_id, stream_id ORDER BY ts_ns, seq) AS n FROM messages WHERE is_req) q JOIN
 (SELECT *, row_number() OVER (PARTITION BY conn_id, stream_id ORDER BY ts_ns, seq) AS n FROM (SELECT *, least(coalesce(min(bal) OVER (PARTITION BY conn_id, stream_id ORDER BY ts_ns, CASE WHEN is_req THEN 0 ELSE 1 END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS low FROM
  (SELECT *, sum(CASE WHEN is_req THEN 1 ELSE -1 END) OVER (PARTITION BY conn_id, stream_id ORDER BY ts_ns, CASE WHEN is_req THEN 0 ELSE 1 END, seq ROWS UNBOUNDED PRECEDING) AS bal FROM messages)) WHERE NOT is_req AND bal >= low) r
 ON q.conn_id = r.conn_id AND q.stream_id = r.stream_id AND q.n = r.n""", (MESSAGES,))
def d4(spark, sf):
    return pairing.pair_queued(adapters.messages(spark, sf))


def _frames(spark, sf):
    """Chains of up to four frames: of each four in a row the next continues the one before."""
    m = adapters.messages(spark, sf).where("not is_req")
    order = Window.partitionBy("conn_id").orderBy("ts_ns", "seq")
    m = m.withColumn("n", F.row_number().over(order))
    return m.select("conn_id", "request_id", F.when((c("n") % 4) != 1, F.lag("request_id").over(order)).otherwise(F.lit(-1)).alias("response_to"), (c("n") % 4 != 0).alias("more_to_come"), "byte_size", "body")


@query("d6_stitch_chains", """SELECT conn_id, min(head) AS head_id, count(*) AS frames, CAST(sum(byte_size) AS BIGINT) AS byte_size, string_agg(body || ' ', '' ORDER BY n) AS body FROM (SELECT *, first_value(request_id) OVER (PARTITION BY conn_id, (n - 1) // 4 ORDER BY n) AS head FROM
 (SELECT *, row_number() OVER (PARTITION BY conn_id ORDER BY ts_ns, seq) AS n FROM messages WHERE NOT is_req)) GROUP BY conn_id, (n - 1) // 4""", (MESSAGES,))
def d6(spark, sf):
    return pairing.stitch_chains(_frames(spark, sf))


@query("d7_response_runs", """SELECT conn_id, req_seq, count(*) AS packets, CAST(sum(byte_size) AS BIGINT) AS resp_size, max(ts_ns) AS resp_ts, CASE arg_min(head, n) WHEN 0 THEN 1 WHEN 255 THEN 2 ELSE 3 END AS status FROM (
 SELECT *, min(CASE WHEN pid2 = n % 256 THEN 1 ELSE 0 END) OVER (PARTITION BY conn_id, req_seq ORDER BY n ROWS UNBOUNDED PRECEDING) AS fits FROM (SELECT *, row_number() OVER (PARTITION BY conn_id, req_seq ORDER BY ts_ns, seq) AS n,
 CASE WHEN k % 10 = 0 THEN 77 ELSE row_number() OVER (PARTITION BY conn_id, req_seq ORDER BY ts_ns, seq) END AS pid2 FROM (SELECT *, last_value(CASE WHEN is_req THEN seq END IGNORE NULLS) OVER (PARTITION BY conn_id ORDER BY ts_ns, CASE WHEN is_req THEN 1 ELSE 0 END, seq ROWS UNBOUNDED PRECEDING) AS req_seq,
 CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 255 ELSE 7 END AS head FROM messages) WHERE NOT is_req AND req_seq IS NOT NULL)) WHERE fits = 1 GROUP BY conn_id, req_seq""", (MESSAGES,))
def d7(spark, sf):
    """Packet ids count up from the request, but for every tenth packet, which breaks the run."""
    m = adapters.messages(spark, sf).withColumn("head", F.when(c("k") % 3 == 0, 0).when(c("k") % 3 == 1, 255).otherwise(7))
    w = Window.partitionBy("conn_id").orderBy("ts_ns", c("is_req").cast("int"), "seq")
    runs = m.withColumn("_r", F.sum(c("is_req").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("conn_id", "_r", "is_req").orderBy("ts_ns", "seq"))
    return pairing.group_response_runs(runs.withColumn("packet_id", F.when(c("k") % 10 == 0, 77).otherwise(n)))


@query("d8_statements", """SELECT conn_id, stmt_id, ts_ns, seq, coalesce('query=[' || CASE WHEN open THEN body_of END || '] params=[' || k || ', ' || stmt_id || ']', 'Execute stmt_id=' || stmt_id || '.') AS text FROM (
 SELECT *, last_value(CASE command WHEN 'prepare' THEN true WHEN 'close' THEN false END IGNORE NULLS) OVER w AS open, last_value(CASE command WHEN 'prepare' THEN body END IGNORE NULLS) OVER w AS body_of FROM
 (SELECT *, CASE event_type WHEN 'view' THEN 'prepare' WHEN 'click' THEN 'execute' WHEN 'purchase' THEN 'execute' ELSE 'close' END AS command FROM messages) WINDOW w AS (PARTITION BY conn_id, stmt_id ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)) WHERE command = 'execute'""", (MESSAGES,))
def d8(spark, sf):
    kind = F.when(c("event_type") == "view", "prepare").when(c("event_type").isin("click", "purchase"), "execute").otherwise("close")
    m = adapters.messages(spark, sf).withColumns({"command": kind, "params": F.array(c("k").cast("string"), c("stmt_id").cast("string"))})
    return pairing.join_statements(m)


@query("d17_unmatched", f"SELECT conn_id, count(*) FILTER (is_req) AS requests, count(*) FILTER (NOT is_req) AS responses FROM messages m WHERE NOT EXISTS (SELECT 1 FROM ({_lag_sql('conn_id', 'response')}) p WHERE p.conn_id = m.conn_id AND (p.req_seq = m.seq OR p.resp_seq = m.seq)) GROUP BY conn_id", (MESSAGES,))
def d17(spark, sf):
    m = adapters.messages(spark, sf)
    return pairing.unmatched(m, pairing.pair_fifo(m))


@query("j1_protocols", f"SELECT 'kafka' AS protocol, count(*) AS n, CAST(max(resp_ts - req_ts) AS BIGINT) AS slowest_ns FROM ({_id_sql('', 'DESC', 'WHERE q.ts_ns <= r.ts_ns')}) UNION ALL SELECT 'mongodb', count(*), CAST(max(resp_ts - req_ts) AS BIGINT) FROM ({_lag_sql('conn_id, stream_id', 'request')}) UNION ALL SELECT 'http', count(*), CAST(max(resp_ts - req_ts) AS BIGINT) FROM ({_lag_sql('conn_id', 'response')})", (MESSAGES,))
def j1(spark, sf):
    """The same messages under the rules of three protocols."""
    m = adapters.messages(spark, sf)
    parts = [PROTOCOLS[n].pairs(m).select(F.lit(n).alias("protocol"), "latency_ns") for n in ("http", "kafka", "mongodb")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.max("latency_ns").alias("slowest_ns"))


# --- connections -----------------------------------------------------------------------------------------------------------
@query("connections", "SELECT * FROM connections", (CONN_EVENTS,))
def connection_intervals(spark, sf):
    return connections.lifecycles(adapters.conn_events(spark, sf))


@query("d9_connection_of_event", """SELECT event_id, tgid_fd, ts_ns, start_ns FROM (SELECT e.event_id, e.user_id AS tgid_fd, e.ts_ns, CASE WHEN x.newest < e.ts_ns THEN x.newest ELSE (SELECT max(o.start_ns) FROM connections o WHERE o.tgid_fd = e.user_id AND o.next_ns IS NOT NULL AND o.start_ns <= e.ts_ns AND e.ts_ns <= coalesce(o.close_ns, o.next_ns)) END AS start_ns
 FROM events_v e JOIN (SELECT tgid_fd, max(start_ns) AS newest FROM connections GROUP BY tgid_fd) x ON x.tgid_fd = e.user_id) WHERE start_ns IS NOT NULL""", (CONN_EVENTS,))
def d9(spark, sf):
    e = adapters.events(spark, sf).select("event_id", c("user_id").alias("tgid_fd"), "ts_ns")
    return connections.lookup(e, connections.lifecycles(adapters.conn_events(spark, sf)))


@query("d12_first_packets", "SELECT r.record_id, 1::BIGINT AS seq, x.ts_ns FROM (SELECT local_addr, local_port, remote_addr, remote_port, min(start_ns) AS ts_ns FROM records GROUP BY ALL) x JOIN records r USING (local_addr, local_port, remote_addr, remote_port)", (RECORDS,))
def d12(spark, sf):
    r = adapters.records(spark, sf)
    keys = ["local_addr", "local_port", "remote_addr", "remote_port"]
    packets = r.groupBy(*keys).agg(F.min("start_ns").alias("ts_ns"))
    return connections.first_packets(packets, r.select("record_id", *keys)).select("record_id", "seq", "ts_ns")


@query("e12_connection_counters", "SELECT tgid_fd, count(*) FILTER (kind = 'connect') AS added, count(*) FILTER (kind = 'close') AS closed, count(*) FILTER (kind = 'connect') - count(*) FILTER (kind = 'close') AS open FROM conn_events GROUP BY tgid_fd", (CONN_EVENTS,))
def e12(spark, sf):
    return connections.counters(adapters.conn_events(spark, sf))


@query("e13_handshakes", "SELECT conn_id, min(ts_ns) FILTER (step = 10 AND flags & 2 <> 0) AS syn_ns, min(ts_ns) FILTER (step <= 7 AND flags & 16 <> 0) AS ack_ns, min(ts_ns) FILTER (step <= 7 AND flags & 16 <> 0) - min(ts_ns) FILTER (step = 10 AND flags & 2 <> 0) AS handshake_ns FROM (SELECT *, CASE WHEN step = 3 THEN 10 ELSE step END AS step2 FROM kern) SELECT_0 GROUP BY conn_id".replace("step = 10", "step2 = 10").replace("step <= 7", "step2 <= 7"), (KERN,))
def e13(spark, sf):
    k = adapters.kern_events(spark, sf)
    return connections.handshakes(k.withColumn("step", F.when(c("step") == names.TCP_OUT, names.IP_IN).otherwise(c("step"))))


@query("e14_inferred_protocol", "SELECT tgid_fd, protocol, role FROM conn_events WHERE kind = 'protocol_infer' QUALIFY row_number() OVER (PARTITION BY tgid_fd ORDER BY ts_ns, seq) = 1", (CONN_EVENTS,))
def e14(spark, sf):
    return connections.inferred_protocol(adapters.conn_events(spark, sf))


#: Reads of a connection by k % 12: HTTP both ways, RESP, MySQL, DNS, text of nobody, Mongo, RocketMQ, Kafka; then in two reads, length
#: first, Kafka and MySQL, and a length that is not that of what follows. Expected: (protocol, message, prepended) of the last read.
_READS = [["474554202F20485454502F312E310D0A0D0A"], ["485454502F312E3120323030204F4B0D0A0D0A"], ["3A370D0A"], ["090000000353454C4543542031"], ["1A2B0100000100000000000003777777"], ["706C61696E2074657874206F66206E6F626F6479"],
          ["100000000700000000000000DD070000"], ["0000001E0000001A7B22636F6465223A31307D" + "20" * 15], ["0000000C000300010000000700000000"], ["0000000C", "000300010000000700000000"], ["05000000", "0353454C45"], ["0000000C", "00030001000000070000000000"]]
_READ_TAGS = {0: (2, "req", False), 1: (2, "resp", False), 2: (8, "any", False), 3: (4, "req", False), 4: (7, "req", False), 6: (10, "req", False), 7: (14, "req", False), 8: (11, "req", False), 9: (11, "req", True), 10: (4, "req", False)}
_READ_SQL = MESSAGES + ", reads AS (SELECT m.*, u.i, m.seq * 2 + u.i AS arrival, m.seq % 2 = 0 AS egress FROM messages m, (VALUES (0), (1)) u(i) WHERE u.i = 0 OR m.k % 12 >= 9), tags AS (SELECT r.*, " + ", ".join(
    f"CASE WHEN i = 1 OR k % 12 < 9 THEN CASE k % 12 {' '.join(f'WHEN {k} THEN {str(t[at]).lower() if at == 2 else repr(t[at])}' for k, t in _READ_TAGS.items())} END END AS {name}" for at, name in enumerate(("protocol", "message", "prepended"))) + " FROM reads r)"


def _reads(spark, sf):
    kinds = F.array(*[F.array(*[F.lit(x) for x in reads]) for reads in _READS])
    m = adapters.messages(spark, sf).select("conn_id", "ts_ns", "seq", F.posexplode(F.get(kinds, (c("k") % 12).cast("int"))).alias("i", "h"))
    return m.select("conn_id", "ts_ns", (c("seq") * 2 + c("i")).alias("arrival"), (c("seq") % 2 == 0).alias("egress"), F.unhex("h").alias("payload"))


@query("b13_reads", "SELECT conn_id, arrival, CAST(protocol AS INTEGER) AS protocol, message, prepended FROM tags", (_READ_SQL,))
def b13_reads(spark, sf):
    return inference.tagged_reads(_reads(spark, sf)).select("conn_id", "arrival", "protocol", "message", "prepended")


@query("e14_first_inference", """SELECT conn_id, CAST(protocol AS INTEGER) AS protocol, CASE WHEN message = 'any' THEN 'unknown' WHEN egress = (message = 'req') THEN 'client' ELSE 'server' END AS role, ts_ns, prepended FROM tags WHERE protocol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conn_id ORDER BY ts_ns, arrival) = 1""", (_READ_SQL,))
def e14_reads(spark, sf):
    return inference.inferred_connections(_reads(spark, sf))


@query("e15_events_per_connection", "SELECT conn_id, count(*) AS events FROM kern GROUP BY conn_id", (KERN,))
def e15(spark, sf):
    return connections.events_per_connection(adapters.kern_events(spark, sf))


@query("c28_c29_traceable", "SELECT tgid_fd, protocol, role FROM (SELECT *, tgid_fd % 7 AS local_port FROM conn_events WHERE kind = 'protocol_infer' QUALIFY row_number() OVER (PARTITION BY tgid_fd ORDER BY ts_ns, seq) = 1) WHERE local_port <> 0 AND protocol > 1 AND role = 'client'", (CONN_EVENTS,))
def c28(spark, sf):
    rows = connections.inferred_protocol(adapters.conn_events(spark, sf)).withColumn("local_port", c("tgid_fd") % 7)
    return filters.traceable(filters.without_local_port(rows), side="client").select("tgid_fd", "protocol", "role")


@query("c30_with_payload", "SELECT conn_id, rn, len FROM (SELECT conn_id, rn, len - 1 AS len FROM kern) WHERE len > 0", (KERN,))
def c30(spark, sf):
    return filters.with_payload(adapters.kern_events(spark, sf).select("conn_id", "rn", (c("len") - 1).alias("len")))


# --- byte ranges -----------------------------------------------------------------------------------------------------------
@query("d10_range_overlap", """SELECT k.conn_id, k.rn, r.message, r.start, r."end" FROM kern k JOIN ranges r ON k.conn_id = r.conn_id AND k.seq < r."end" AND k.seq + k.len > r.start""", (KERN,))
def d10(spark, sf):
    return ranges.overlap_join(adapters.kern_events(spark, sf), adapters.message_ranges(spark, sf)).select("conn_id", "rn", "message", "start", "end")


@query("d11_tls_ranges", """SELECT conn_id, start, "end", kern_start, kern_end - kern_start AS kern_len, valid FROM (SELECT r.conn_id, r.start, r."end", arg_min(s, seq) FILTER (s > 0) AS kern_start, arg_max(s + l, seq) AS kern_end, bool_and(l > 0) AS valid FROM
 (SELECT conn_id, seq, len, CASE WHEN rn % 5 = 0 THEN 0 ELSE seq * 2 + 1 END AS s, CASE WHEN rn % 7 = 0 THEN 0 ELSE len * 2 END AS l FROM kern) k JOIN ranges r ON k.conn_id = r.conn_id AND k.seq >= r.start AND k.seq < r."end" GROUP BY ALL)""", (KERN,))
def d11(spark, sf):
    k = adapters.kern_events(spark, sf)
    ssl = k.select("conn_id", "seq", "len", F.when(c("rn") % 5 == 0, 0).otherwise(c("seq") * 2 + 1).cast("long").alias("syscall_seq"), F.when(c("rn") % 7 == 0, 0).otherwise(c("len") * 2).cast("long").alias("syscall_len"))
    return ranges.map_tls(ssl, adapters.message_ranges(spark, sf))


@query("d19_time_of_offset", "SELECT o.conn_id, o.message, o.start AS seq, (SELECT arg_max(s.ts_ns, s.seq) FROM (SELECT conn_id, seq, arg_min(ts_ns, arrival) AS ts_ns FROM segments GROUP BY ALL) s WHERE s.conn_id = o.conn_id AND s.seq <= o.start) AS ts_ns FROM ranges o", (KERN, SEGMENTS))
def d19(spark, sf):
    offsets = adapters.message_ranges(spark, sf).select("conn_id", "message", c("start").alias("seq"))
    return ranges.time_of_offset(offsets, adapters.segments(spark, sf)).select("conn_id", "message", "seq", "ts_ns")


@query("f1_islands", """SELECT conn_id, direction, CAST(0 AS BIGINT) AS epoch, island, min(seq) AS start, max(seq + len) AS "end", count(*) AS segments, CAST(sum(len) AS BIGINT) AS bytes FROM (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR seq > reach THEN 1 ELSE 0 END) OVER (PARTITION BY conn_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM
 (SELECT *, max(seq + len) OVER (PARTITION BY conn_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY conn_id, seq ORDER BY arrival) = 1))) GROUP BY conn_id, direction, island""", (SEGMENTS,))
def f1(spark, sf):
    return reassembly.islands(adapters.segments(spark, sf))


@query("f1_wrapped_islands", """SELECT conn_id, direction, dense_rank() OVER (PARTITION BY conn_id ORDER BY wrapped) - 1 AS epoch, CAST(row_number() OVER (PARTITION BY conn_id ORDER BY wrapped, island) AS BIGINT) AS island, start, "end", segments, bytes FROM (SELECT conn_id, direction, wrapped, island, min(seq) AS start, max(seq + len) AS "end", count(*) AS segments, CAST(sum(len) AS BIGINT) AS bytes FROM (
 SELECT *, sum(CASE WHEN reach IS NULL OR seq > reach THEN 1 ELSE 0 END) OVER (PARTITION BY conn_id, wrapped ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(seq + len) OVER (PARTITION BY conn_id, wrapped ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM
 (SELECT conn_id, direction, seq >= 100 AS wrapped, (seq + 4294967196) % 4294967296 AS seq, len FROM segments QUALIFY row_number() OVER (PARTITION BY conn_id, seq ORDER BY arrival) = 1))) GROUP BY conn_id, direction, wrapped, island)""", (SEGMENTS,))
def f1_wrapped(spark, sf):
    """The numbers of every stream wrap after its first hundred bytes, and segments come in the order of their ship dates."""
    s = adapters.segments(spark, sf)
    return reassembly.wrapped_islands(s.withColumn("seq", (c("seq") + 4294967196) % F.lit(1 << 32)))


@query("f1_reassembled", """, s AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY conn_id, seq ORDER BY arrival) = 1), bytes AS (SELECT conn_id, direction, pos, arg_min(v, arrival) AS v FROM (SELECT conn_id, direction, arrival, unnest(range(seq, seq + len)) AS pos, lpad(to_hex(arrival % 256), 2, '0') AS v FROM s) GROUP BY ALL),
 isl AS (SELECT *, pos - row_number() OVER (PARTITION BY conn_id, direction ORDER BY pos) AS g FROM bytes) SELECT conn_id, direction, min(pos) AS start, upper(string_agg(v, '' ORDER BY pos)) AS payload FROM isl GROUP BY conn_id, direction, g""".replace(", s AS", "SELECT * FROM (WITH s AS", 1) + ")", (SEGMENTS,))
def f1_payload(spark, sf):
    """Each segment is filled with the number of its arrival, so the payload tells whose bytes were kept."""
    s = adapters.segments(spark, sf).withColumn("payload", F.unhex(F.expr("repeat(lpad(hex(arrival % 256), 2, '0'), int(len))")))
    return reassembly.reassemble(s, parts=parts_of(adapters.table(spark, sf, "lineitem"))).select("conn_id", "direction", "start", F.hex("payload").alias("payload"))


# --- packet events and annotation --------------------------------------------------------------------------------------------
@query("e11a_dedupe", "SELECT conn_id, step, seq, min(struct_pack(a := ts_ns, b := len)).a AS ts_ns, min(struct_pack(a := ts_ns, b := len)).b AS len FROM (SELECT conn_id, step, seq // 40 AS seq, ts_ns, len FROM kern) GROUP BY ALL", (KERN,))
def e11a(spark, sf):
    return annotate.dedupe_events(adapters.kern_events(spark, sf).withColumn("seq", F.floor(c("seq") / 40).cast("long")))


@query("e11b_nic_times", "SELECT conn_id, step, seq, count(*) AS interfaces, min(t) AS first_ns, max(t) AS last_ns FROM (SELECT conn_id, 6 + step % 4 AS step, seq // 40 AS seq, ifname, min(ts_ns) AS t FROM kern GROUP BY ALL) GROUP BY conn_id, step, seq", (KERN,))
def e11b(spark, sf):
    k = adapters.kern_events(spark, sf).withColumns({"seq": F.floor(c("seq") / 40).cast("long"), "step": 6 + c("step") % 4})
    return annotate.nic_times(k).select("conn_id", "step", "seq", F.size("times").cast("long").alias("interfaces"), "first_ns", "last_ns")


@query("e9_event_arrays", "SELECT conn_id, message, count(*) AS n, string_agg(len || '@' || ts_ns, ',' ORDER BY seq, ts_ns, len) AS events FROM (SELECT k.*, r.message FROM kern k JOIN ranges r ON k.conn_id = r.conn_id AND k.seq < r.\"end\" AND k.seq + k.len > r.start) GROUP BY conn_id, message", (KERN,))
def e9(spark, sf):
    hit = ranges.overlap_join(adapters.kern_events(spark, sf), adapters.message_ranges(spark, sf))
    out = annotate.event_arrays(hit, ["conn_id", "message"])
    text = F.transform("events", lambda x: F.concat(x["ByteSize"].cast("string"), F.lit("@"), x["Timestamp"].cast("string")))
    return out.select("conn_id", "message", F.size("events").cast("long").alias("n"), F.array_join(text, ",").alias("events"))


#: Steps that the packets of E10 are dealt to.
_E10_STEPS = (names.SYSCALL_OUT, names.DEV_OUT, names.NIC_IN, names.DEV_IN, names.TCP_IN, names.USER_COPY, names.SYSCALL_IN)
_E10_KERN = f"""pairs AS (SELECT conn_id, message AS pair_id, start, "end", CASE WHEN conn_id % 2 = 0 THEN 'client' ELSE 'server' END AS side, conn_id % 3 = 0 AS is_ssl, conn_id % 5 <> 0 AS req_maps, CASE WHEN conn_id % 4 <> 0 THEN conn_id % 7 <> 0 END AS resp_maps,
 1000 * conn_id AS req_ts, 1000 * conn_id + 500 AS resp_ts, 10 + message AS req_size, 20 + message AS resp_size, 15 + message AS req_kern_len, 25 + message AS resp_kern_len FROM ranges),
ev AS (SELECT p.conn_id, p.pair_id, p.side, (k.rn % 2 = 0) = (p.side = 'server') AS comes_in, ({list(_E10_STEPS)})[(k.rn + k.conn_id // 2) % {len(_E10_STEPS)} + 1] AS step, k.seq, k.ts_ns, k.ts_ns + 10 * k.flags AS end_ns, k.ts_ns - k.flags AS first_ns, k.ts_ns + k.len AS last_ns
 FROM kern k JOIN pairs p ON k.conn_id = p.conn_id AND k.seq < p."end" AND k.seq + k.len > p.start)"""


def _e10_sql(devices: bool, sockets: bool, inputs: str = _E10_KERN) -> str:
    """The rules once more, over lists of events in order of their bytes: one list for each kind, empty where it is not traced."""
    kinds = {"writes": (False, names.SYSCALL_OUT, True), "dev_out": (False, names.DEV_OUT, devices), "nic": (True, names.NIC_IN, devices), "dev_in": (True, names.DEV_IN, devices), "tcp": (True, names.TCP_IN, sockets), "copies": (True, names.USER_COPY, sockets), "reads": (True, names.SYSCALL_IN, True)}
    lists = ", ".join(f"coalesce(list(struct_pack(s := seq, t := ts_ns, e := end_ns, f := first_ns, l := last_ns) ORDER BY seq, ts_ns) FILTER ({'comes_in' if into else 'NOT comes_in'} AND step = {step} AND {str(on).lower()}), []) AS {name}" for name, (into, step, on) in kinds.items())
    ends = lambda a, b: f"CASE WHEN len({a}) > 0 THEN {b} END"
    return f"""SELECT * FROM (WITH {inputs}, lists AS (SELECT conn_id, pair_id, {lists} FROM ev GROUP BY conn_id, pair_id),
x AS (SELECT p.*, coalesce(writes, []) AS w, coalesce(dev_out, []) AS d, CASE WHEN len(coalesce(nic, [])) > 0 THEN nic ELSE coalesce(dev_in, []) END AS n, coalesce(tcp, []) AS t, coalesce(copies, []) AS u, coalesce(reads, []) AS r,
 NOT is_ssl OR coalesce(CASE WHEN side = 'server' THEN req_maps ELSE resp_maps END, true) AS cr, NOT is_ssl OR coalesce(CASE WHEN side = 'server' THEN resp_maps ELSE req_maps END, true) AS cw, resp_ts - req_ts AS diff FROM pairs p LEFT JOIN lists USING (conn_id, pair_id)),
y AS (SELECT *, CASE WHEN side = 'server' THEN CASE WHEN len(n) > 0 THEN n[1].f WHEN len(t) > 0 THEN t[1].t WHEN len(u) > 0 THEN u[1].t WHEN len(r) > 0 THEN r[1].t END WHEN len(w) > 0 AND cw THEN list_min(list_transform(w, lambda v: v.t)) ELSE req_ts END AS start_ns,
 CASE WHEN side = 'server' THEN CASE WHEN len(d) > 0 THEN d[-1].l WHEN len(w) > 0 THEN w[-1].e END WHEN len(r) > 0 AND cr THEN list_max(list_transform(r, lambda v: v.e)) ELSE resp_ts END AS end_ns,
 CASE WHEN side = 'server' THEN CASE WHEN len(r) > 0 AND len(w) > 0 AND cr AND cw THEN w[-1].e - r[1].t ELSE diff END WHEN len(n) > 0 AND len(d) > 0 AND cr AND cw THEN list_max(list_transform(n, lambda v: v.f)) - list_min(list_transform(d, lambda v: v.l)) END AS black_box_ns FROM x)
SELECT conn_id, pair_id, side, start_ns, end_ns, CASE WHEN side = 'client' THEN CASE WHEN len(r) > 0 AND len(w) > 0 AND cr AND cw THEN end_ns - start_ns ELSE diff END WHEN NOT {str(devices).lower()} THEN black_box_ns WHEN cr AND cw THEN end_ns - start_ns END AS total_ns, black_box_ns,
 CASE WHEN NOT {str(sockets).lower()} AND len(n) > 0 AND cr AND len(r) > 0 THEN r[-1].e - n[1].f WHEN side = 'server' THEN CASE WHEN len(u) > 0 AND len(t) > 0 AND cr THEN u[-1].t - t[1].t END WHEN (len(u) > 0 OR len(r) > 0) AND len(t) > 0 AND cr THEN CASE WHEN len(u) > 0 THEN u[-1].t ELSE r[-1].e END - t[1].t END AS read_socket_ns,
 CASE WHEN len(t) > 0 AND len(n) > 0 AND CASE WHEN side = 'server' THEN cw ELSE cr END THEN t[-1].t - n[1].t END AS copy_to_sock_ns FROM y)"""


def _e10_inputs(spark, sf):
    n = c("conn_id")
    pairs = adapters.message_ranges(spark, sf).select("conn_id", c("message").alias("pair_id"), "start", "end", F.when(n % 2 == 0, "client").otherwise("server").alias("side"), (n % 3 == 0).alias("is_ssl"), (n % 5 != 0).alias("req_maps"), F.when(n % 4 != 0, n % 7 != 0).alias("resp_maps"), (1000 * n).alias("req_ts"), (1000 * n + 500).alias("resp_ts"),
                                                      (10 + c("message")).cast("long").alias("req_size"), (20 + c("message")).cast("long").alias("resp_size"), (15 + c("message")).cast("long").alias("req_kern_len"), (25 + c("message")).cast("long").alias("resp_kern_len"))
    hit = ranges.overlap_join(adapters.kern_events(spark, sf), pairs.select("conn_id", "pair_id", "start", "end"))
    step = F.get(F.array(*[F.lit(x) for x in _E10_STEPS]), ((c("rn") + F.floor(n / 2)) % len(_E10_STEPS)).cast("int"))
    return pairs, hit.select("conn_id", "pair_id", (c("rn") % 2 == 0).alias("is_req"), step.alias("step"), "seq", "ts_ns", (10 * c("flags")).cast("long").alias("ts_delta"), (c("ts_ns") - c("flags")).alias("first_ns"), (c("ts_ns") + c("len")).alias("last_ns"))


def _e10(name, devices=True, sockets=True):
    @query(name, _e10_sql(devices, sockets), (KERN,))
    def run(spark, sf):
        pairs, events = _e10_inputs(spark, sf)
        return annotate.annotate(pairs, events, trace_devices=devices, trace_sockets=sockets).select("conn_id", "pair_id", "side", "start_ns", "end_ns", "total_ns", "black_box_ns", "read_socket_ns", "copy_to_sock_ns")


_e10("e10_annotate")
_e10("e10_without_devices", devices=False)
_e10("e10_without_sockets", sockets=False)


@query("e10z_sizes", f"SELECT * FROM (WITH {_E10_KERN} SELECT conn_id, pair_id, CASE WHEN is_ssl THEN req_kern_len ELSE req_size END::BIGINT AS req_size, CASE WHEN is_ssl THEN resp_kern_len ELSE resp_size END::BIGINT AS resp_size, CASE WHEN is_ssl THEN req_size END::BIGINT AS req_plain_size, CASE WHEN is_ssl THEN resp_size END::BIGINT AS resp_plain_size FROM pairs)", (KERN,))
def e10z(spark, sf):
    pairs, _ = _e10_inputs(spark, sf)
    return annotate.sizes(pairs).select("conn_id", "pair_id", "req_size", "resp_size", "req_plain_size", "resp_plain_size")


@query("f2_b21_hops", "SELECT conn_id AS record_id, 'out' AS direction, CAST(row_number() OVER w AS INTEGER) AS hop, ifname, t AS ts_ns, t - coalesce(lag(t) OVER w, s) AS used_ns FROM (SELECT conn_id, ifname, min(ts_ns) AS t, min(min(ts_ns)) OVER (PARTITION BY conn_id) - 100 AS s FROM kern GROUP BY conn_id, ifname) WINDOW w AS (PARTITION BY conn_id ORDER BY t, ifname)", (KERN,))
def f2(spark, sf):
    k = adapters.kern_events(spark, sf).groupBy("conn_id", "ifname").agg(F.min("ts_ns").alias("t"))
    entry = F.struct(F.concat(F.lit("time-"), c("ifname")), c("t"))
    r = k.groupBy("conn_id").agg((F.min("t") - 100).alias("start_ns"), F.map_from_entries(F.collect_list(entry)).alias("attributes"))
    return hops.hops(r.select(c("conn_id").alias("record_id"), F.lit("out").alias("direction"), "start_ns", "attributes"))


# --- sets and dimensions -----------------------------------------------------------------------------------------------------
@query("h1_timeline", "SELECT family, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM (SELECT 'kern' AS family, ts_ns FROM kern UNION ALL SELECT 'conn', ts_ns FROM conn_events UNION ALL SELECT 'segment', ts_ns FROM segments) GROUP BY family", (KERN, CONN_EVENTS, SEGMENTS))
def h1(spark, sf):
    t = timeline.timeline({"kern": adapters.kern_events(spark, sf), "conn": adapters.conn_events(spark, sf), "segment": adapters.segments(spark, sf)})
    return t.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


@query("h2_prioritised", "SELECT id, CASE WHEN root_pid % 2 = 0 THEN 'docker' WHEN root_pid % 3 = 0 THEN 'containerd' END AS engine FROM containers", (CONTAINERS,))
def h2(spark, sf):
    rows = adapters.containers(spark, sf)
    engine = lambda name, where: rows.where(where).select("id", F.lit(name).alias("engine"))
    return enrich.attach_prioritised(rows.select("id"), [engine("docker", "root_pid % 2 = 0"), engine("containerd", "root_pid % 3 = 0")])


@query("h3_fallback", f"SELECT conn_id, coalesce(min(ts_ns) FILTER (step = {names.NIC_IN}), min(ts_ns) FILTER (step = {names.DEV_IN})) AS nic_in_ns FROM kern GROUP BY conn_id", (KERN,))
def h3(spark, sf):
    return annotate.ingress_nic(adapters.kern_events(spark, sf), ["conn_id"])


_BY_NS = "LEFT JOIN (SELECT {0}, min(struct_pack(s := sandbox, i := id, n := name)) AS f, count(*) AS n FROM containers WHERE {0} > 0 {1} GROUP BY {0}) {2} ON {2}.{0} = p.{0} AND ({2}.n = 1 OR NOT {2}.f.s)"


@query("d13_containers_of_processes", "SELECT p.pid, coalesce(a.x.i, b.f.i) AS container_id, coalesce(a.x.n, b.f.n) AS container_name FROM processes p LEFT JOIN (SELECT root_pid, min(struct_pack(i := id, n := name)) AS x FROM containers GROUP BY root_pid) a ON a.root_pid = p.pid " + _BY_NS.format("net_ns", "", "b"), (PROCESSES, CONTAINERS))
def d13(spark, sf):
    return enrich.attach_containers(adapters.processes(spark, sf), adapters.containers(spark, sf)).select("pid", "container_id", "container_name")


@query("d13_four_lookups", "SELECT p.pid, coalesce(a.x.i, b.f.i, m.f.i, r.i) AS container_id FROM (SELECT *, 4026532000 + pid % 120 AS mnt_ns, CASE WHEN pid % 4 = 0 THEN left(md5('c' || (pid % 300)), 12 + pid % 20) WHEN pid % 4 = 1 THEN md5('c' || (pid % 300)) WHEN pid % 4 = 2 THEN left(md5('c' || (pid % 300)), 8) END AS ref FROM processes) p LEFT JOIN (SELECT root_pid, min(struct_pack(i := id)) AS x FROM containers WHERE root_pid % 7 = 0 GROUP BY root_pid) a ON a.root_pid = p.pid "
       + _BY_NS.format("net_ns", "AND net_ns <> 4026533007 AND root_pid % 7 = 0", "b") + " " + _BY_NS.format("mnt_ns", "AND mnt_ns <> 4026532011 AND root_pid % 7 = 0", "m") + " LEFT JOIN (SELECT id AS i FROM containers WHERE root_pid % 7 = 0) r ON (r.i = p.ref OR (length(p.ref) BETWEEN 12 AND 63 AND starts_with(r.i, p.ref)))", (PROCESSES, CONTAINERS))
def d13_all(spark, sf):
    """Every seventh container only, so that all four ways have their turn; the host has namespaces of its own."""
    pid = c("pid")
    whole = F.md5(F.concat(F.lit("c"), (pid % 300).cast("string")))
    ref = F.when(pid % 4 == 0, F.substring(whole, F.lit(1), (12 + pid % 20).cast("int"))).when(pid % 4 == 1, whole).when(pid % 4 == 2, F.substring(whole, 1, 8))
    p = adapters.processes(spark, sf).withColumns({"mnt_ns": 4026532000 + pid % 120, "container_ref": ref})
    return enrich.attach_containers(p, adapters.containers(spark, sf).where("root_pid % 7 = 0"), 4026533007, 4026532011).select("pid", "container_id")


@query("d14_a5_pods", "SELECT id, pod, namespace, substr(name, 2) AS container FROM containers", (CONTAINERS,))
def d14(spark, sf):
    return enrich.with_pods(readers.parsed_labels(adapters.containers(spark, sf))).select("id", "pod", "namespace", "container")


@query("d15_process_tree", "below AS (SELECT pid FROM processes WHERE name = '/usr/bin/red-widget' UNION SELECT p.pid FROM below b JOIN processes p ON p.ppid = b.pid AND p.pid <> p.ppid) SELECT record_id, pid FROM records WHERE pid IN (SELECT pid FROM below)".replace("below AS", "SELECT * FROM (WITH RECURSIVE below AS", 1) + ")", (RECORDS, PROCESSES))
def d15(spark, sf):
    p = adapters.processes(spark, sf)
    return enrich.of_process_tree(adapters.records(spark, sf), p, p.where("name = '/usr/bin/red-widget'")).select("record_id", "pid")


#: Processes of 40 pids that are used again and again: signups begin one, errors end it.
_LIVES = EVENTS + """, px AS (SELECT user_id % 40 AS pid, CASE event_type WHEN 'signup' THEN 'exec' ELSE 'exit' END AS kind, max(struct_pack(name := '/usr/bin/worker-' || (k % 5), ppid := (user_id * 7 + k) % 40)) AS p, ts_ns FROM events_v WHERE event_type IN ('signup', 'error') GROUP BY ALL),
lives AS (SELECT pid || '@' || ts_ns AS life, pid, p.ppid AS ppid, p.name AS name, ts_ns AS start_ns, end_ns, lead(ts_ns) OVER (PARTITION BY pid ORDER BY ts_ns) AS next_ns FROM (SELECT *, lead(ts_ns) OVER (PARTITION BY pid ORDER BY ts_ns, kind = 'exec') AS end_ns FROM px) WHERE kind = 'exec'),
calls AS (SELECT event_id, user_id % 40 AS pid, ts_ns FROM events_v WHERE event_type IN ('view', 'click', 'purchase'))"""


def _lives(spark, sf):
    e = adapters.events(spark, sf)
    kind = F.when(c("event_type") == "signup", "exec").when(c("event_type") == "error", "exit")
    pid = c("user_id") % 40
    rows = e.select(pid.alias("pid"), ((c("user_id") * 7 + c("k")) % 40).alias("ppid"), kind.alias("kind"), F.concat(F.lit("/usr/bin/worker-"), (c("k") % 5).cast("string")).alias("name"), F.lit(None).cast("long").alias("net_ns"), "ts_ns").where("kind is not null")
    calls = e.where(c("event_type").isin("view", "click", "purchase")).select("event_id", pid.alias("pid"), "ts_ns")
    return lifetimes.lifetimes(rows), calls


@query("a4_lifetimes", "SELECT pid, ppid, name, start_ns, end_ns FROM lives", (_LIVES,))
def a4_lifetimes(spark, sf):
    return _lives(spark, sf)[0].select("pid", "ppid", "name", "start_ns", "end_ns")


@query("c1_c2_process_at_time", "SELECT event_id, c.pid, name AS process_name, start_ns AS process_start_ns FROM calls c LEFT JOIN lives v ON v.pid = c.pid AND c.ts_ns >= v.start_ns AND (v.end_ns IS NULL OR c.ts_ns < least(v.end_ns + 60000000000, coalesce(v.next_ns, v.end_ns + 60000000000)))", (_LIVES,))
def c1_lifetimes(spark, sf):
    """A process is found for a minute after its end, unless its pid has begun anew."""
    lives, calls = _lives(spark, sf)
    return lifetimes.processes_at(calls, lives, "ts_ns", grace_ns=60_000_000_000).select("event_id", "pid", "process_name", "process_start_ns")


@query("d15_tree_at_time", """, links AS (SELECT v.life, p.life AS parent FROM lives v JOIN lives p ON p.pid = v.ppid AND v.ppid <> v.pid AND p.start_ns < v.start_ns AND (p.end_ns IS NULL OR v.start_ns - 1 < p.end_ns)),
 below AS (SELECT life FROM lives WHERE contains(name, '/worker-3') UNION SELECT l.life FROM below b JOIN links l ON l.parent = b.life) SELECT event_id, c.pid FROM calls c JOIN lives v ON v.pid = c.pid AND c.ts_ns >= v.start_ns AND (v.end_ns IS NULL OR c.ts_ns < v.end_ns) WHERE v.life IN (SELECT life FROM below)""".replace(", links AS", "SELECT * FROM (WITH RECURSIVE links AS", 1) + ")", (_LIVES,))
def d15_lifetimes(spark, sf):
    lives, calls = _lives(spark, sf)
    return lifetimes.of_tree_at(calls, lives, lifetimes.named("worker-3"), "ts_ns").select("event_id", "pid")


@query("d18_namespaces", "SELECT pid, net_ns FROM processes WHERE net_ns IN (SELECT net_ns FROM containers WHERE namespace = 'machinery' AND net_ns <> 0)", (PROCESSES, CONTAINERS))
def d18(spark, sf):
    chosen = enrich.with_pods(readers.parsed_labels(adapters.containers(spark, sf))).where("namespace = 'machinery'")
    return enrich.in_namespaces(adapters.processes(spark, sf), chosen).select("pid", "net_ns")


@query("a3_a4_event_families", """SELECT family, count(*) AS n, CAST(sum(key % 1000003 + ts_ns % 1000003) AS BIGINT) AS digest FROM (SELECT 'conn' AS family, tgid_fd AS key, ts_ns FROM conn_events UNION ALL SELECT 'kern', conn_id + seq + len + step, ts_ns FROM kern UNION ALL SELECT 'syscall', conn_id + seq + arrival, ts_ns FROM segments
 UNION ALL SELECT 'ssl', conn_id + seq + seq + 1, ts_ns FROM segments UNION ALL SELECT 'first_packet', local_port + len, ts_ns FROM (SELECT local_port, req_size AS len, start_ns AS ts_ns FROM records) UNION ALL SELECT 'proc', pid + coalesce(ppid, 0), 5 FROM processes) GROUP BY family""", (CONN_EVENTS, KERN, SEGMENTS, RECORDS.removeprefix(EVENTS + ", "), PROCESSES))
def a3(spark, sf):
    """Every family written in its schema and read as what it is."""
    none = lambda kind: F.lit(None).cast(kind)
    conn = adapters.conn_events(spark, sf)
    kern, seg, rec = adapters.kern_events(spark, sf), adapters.segments(spark, sf), adapters.records(spark, sf)
    made = {
        "conn": (conn.select("tgid_fd", "kind", "ts_ns"), c("tgid_fd")),
        "kern": (kern.select(c("conn_id").alias("tgid_fd"), "step", "seq", "len", "ts_ns", "flags", "ifname"), c("tgid_fd") + c("seq") + c("len") + c("step")),
        "syscall": (seg.select(c("conn_id").alias("tgid_fd"), "direction", "seq", "arrival", "ts_ns"), c("tgid_fd") + c("seq") + c("arrival")),
        "ssl": (seg.select(c("conn_id").alias("tgid_fd"), "direction", "seq", "arrival", "ts_ns", (c("seq") + 1).alias("syscall_seq")), c("tgid_fd") + c("seq") + c("syscall_seq")),
        "first_packet": (rec.select("local_addr", "local_port", "remote_addr", "remote_port", c("start_ns").alias("ts_ns"), c("req_size").alias("len")), c("local_port") + c("len")),
        "proc": (adapters.processes(spark, sf).select("pid", "ppid", F.lit("exec").alias("kind"), "name", "net_ns", F.lit(5).alias("ts_ns")), c("pid") + F.coalesce("ppid", F.lit(0))),
    }
    out = None
    for family, (rows, key) in made.items():
        fields = spark.createDataFrame([], FAMILIES[family]).schema.fields
        path = scratch_path(spark, f"events-{family}")
        rows.select(*[(c(f.name) if f.name in rows.columns else none(f.dataType)).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(path)
        got = readers.read_events(spark, path, family).select(F.lit(family).alias("family"), key.cast("long").alias("key"), "ts_ns")
        out = got if out is None else out.unionByName(got)
    return out.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(c("key") % 1000003 + c("ts_ns") % 1000003).alias("digest"))
