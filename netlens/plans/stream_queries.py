"""Queries that run the streaming operators over the event table as a stream, to its end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netlens.functions import names
from netlens.operators import rollups
from netlens.operators import stats as batch_stats
from netlens.plans.event_queries import _E10_STEPS, _e10_sql
from netlens.plans.oracle import EVENTS, MESSAGES, RECORDS
from netlens.plans.record_queries import _EXPORTED, _FIELDS, _stat_sql
from netlens.plans.registry import query
from netlens.sources import adapters, readers
from netlens.streaming import annotate, order, pairing, reassembly, stats
from netlens.streaming.run import event_time, run_available, scratch

c = F.col


def _records(spark, sf):
    return adapters.records_of(adapters.events_of(adapters.stream(spark, sf, "events")))


def _messages(spark, sf):
    e, k = adapters.events_of(adapters.stream(spark, sf, "events")), c("k")
    return e.select(c("user_id").alias("conn_id"), c("event_type").isin("view", "click", "signup").alias("is_req"), "ts_ns", c("event_id").alias("seq"), (64 + k).alias("byte_size"), (k % 25).alias("corr_id"), "event_type")


@query("a2_stream_json", _EXPORTED, (RECORDS,))
def a2_stream(spark, sf):
    """The stream's records as JSON, written once each, and read again."""
    path = scratch(spark)
    readers.stream_records_json(_records(spark, sf), f"{path}/json", f"{path}/state", available_now=True).awaitTermination()
    return readers.read_records(spark, f"{path}/json").select(*_FIELDS)


@query("a7_j4_hooks", "SELECT protocol, count(*) AS records, CAST(sum(req_size) AS BIGINT) AS bytes FROM records GROUP BY protocol", (RECORDS,))
def a7(spark, sf):
    """A hook that counts each batch."""
    path = scratch(spark)
    count = lambda batch, number: batch.groupBy("protocol").agg(F.count(F.lit(1)).alias("records"), F.sum("req_size").alias("bytes")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
    readers.for_each_batch(_records(spark, sf), count, f"{path}/state", available_now=True).awaitTermination()
    return spark.read.schema("protocol int, records long, bytes long").parquet(f"{path}/counts").groupBy("protocol").agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


@query("i1_cumulative", "SELECT * FROM (WITH " + _stat_sql("remote-ip", "respsize").removeprefix(", ") + ")", (RECORDS,))
def i1(spark, sf):
    return run_available(stats.cumulative(_records(spark, sf), "remote-ip", "respsize"), "complete")


@query("i2_i3_windows", "SELECT start_ns // 3600000000000 * 3600000000 AS window_us, CAST(protocol AS VARCHAR) AS class_id, count(*) AS count, max(CAST(resp_size AS DOUBLE)) AS max, CAST(sum(resp_size) AS DOUBLE) AS total FROM records GROUP BY ALL HAVING (start_ns // 3600000000000 + 1) * 3600000000 <= (SELECT max(start_ns) // 1000000 * 1000 FROM records) - 1000000".replace("GROUP BY ALL HAVING (start_ns // 3600000000000 + 1) * 3600000000", "GROUP BY window_us, class_id HAVING window_us + 3600000000"), (RECORDS,))
def i2(spark, sf):
    """Windows of an hour that are over by a second before the last event."""
    return run_available(stats.windowed(_records(spark, sf), 3600, "protocol", "respsize")).select("window_us", "class_id", "count", "max", "total")


@query("i2_merged_windows", "SELECT * FROM (WITH " + _stat_sql("protocol", "respsize", "WHERE (start_ns // 3600000000000 + 1) * 3600000000 <= (SELECT max(start_ns) // 1000000 * 1000 FROM records) - 1000000").removeprefix(", ") + ")", (RECORDS,))
def i2_merged(spark, sf):
    """States of the windows that are over, merged to the whole."""
    return rollups.measured(rollups.merged(run_available(stats.windowed_states(_records(spark, sf), 3600, "protocol", "respsize")), "class_id"), total=True)


@query("i4_pair_by_id", "SELECT q.conn_id, q.corr_id, q.ts_ns AS req_ts, r.ts_ns AS resp_ts, q.seq AS req_seq, r.seq AS resp_seq FROM messages q JOIN messages r ON q.conn_id = r.conn_id AND q.corr_id = r.corr_id AND q.is_req AND NOT r.is_req AND r.ts_ns >= q.ts_ns AND r.ts_ns <= q.ts_ns + 3600000000000", (MESSAGES,))
def i4a(spark, sf):
    return run_available(pairing.pair_by_id(_messages(spark, sf), timeout="60 minutes"))


_FIFO = "SELECT conn_id, req_ts, ts_ns AS resp_ts, req_seq, seq AS resp_seq FROM (SELECT *, lag(is_req) OVER w AS was, lag(ts_ns) OVER w AS req_ts, lag(seq) OVER w AS req_seq FROM messages WINDOW w AS (PARTITION BY conn_id ORDER BY ts_ns, CASE WHEN is_req THEN 1 ELSE 0 END, seq)) WHERE NOT is_req AND was"


@query("i4_pair_fifo", _FIFO + " AND ts_ns <= (SELECT max(ts_ns) // 1000000 * 1000000 FROM messages) - 1000000000", (MESSAGES,))
def i4b(spark, sf):
    """Pairs that the last watermark has passed."""
    return run_available(pairing.pair_fifo(_messages(spark, sf), keep_ms=400 * 86_400_000))


_PASSED = "(SELECT max(ts_ns) // 1000000 * 1000000 FROM messages) - 1000000000"


@query("i4_pair_fifo_timeout", _FIFO + f" AND ts_ns - req_ts <= 3600000000000 AND ts_ns <= {_PASSED}", (MESSAGES,))
def i4b_timeout(spark, sf):
    """Requests wait an hour."""
    return run_available(pairing.pair(_messages(spark, sf), "fifo", ("conn_id",), keep_ms=3_600_000))


@query("i4_pair_opaque", """SELECT conn_id, corr_id, req_ts, ts_ns AS resp_ts, req_seq, seq AS resp_seq FROM (SELECT *, lag(is_req) OVER w AS was, lag(ts_ns) OVER w AS req_ts, lag(seq) OVER w AS req_seq FROM messages WINDOW w AS (PARTITION BY conn_id, corr_id ORDER BY ts_ns, CASE WHEN is_req THEN 0 ELSE 1 END, seq))
 WHERE NOT is_req AND was AND ts_ns - req_ts <= 864000000000000 AND ts_ns <= """ + _PASSED, (MESSAGES,))
def i4a_opaque(spark, sf):
    """Requests wait ten days."""
    return run_available(pairing.pair(_messages(spark, sf), "opaque", ("conn_id", "corr_id"), keep_ms=864_000_000))


@query("i4_pair_queued", f"""SELECT q.conn_id, q.corr_id, q.ts_ns AS req_ts, r.ts_ns AS resp_ts, q.seq AS req_seq, r.seq AS resp_seq FROM
 (SELECT *, row_number() OVER (PARTITION BY conn_id, corr_id ORDER BY ts_ns, seq) AS n FROM messages WHERE is_req) q JOIN
 (SELECT *, row_number() OVER (PARTITION BY conn_id, corr_id ORDER BY ts_ns, seq) AS n FROM (SELECT *, least(coalesce(min(bal) OVER (PARTITION BY conn_id, corr_id ORDER BY ts_ns, CASE WHEN is_req THEN 0 ELSE 1 END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS low FROM
  (SELECT *, sum(CASE WHEN is_req THEN 1 ELSE -1 END) OVER (PARTITION BY conn_id, corr_id ORDER BY ts_ns, CASE WHEN is_req THEN 0 ELSE 1 END, seq ROWS UNBOUNDED PRECEDING) AS bal FROM messages)) WHERE NOT is_req AND bal >= low) r
 ON q.conn_id = r.conn_id AND q.corr_id = r.corr_id AND q.n = r.n WHERE r.ts_ns <= {_PASSED}""", (MESSAGES,))
def i4a_queued(spark, sf):
    """Requests wait for as long as it takes."""
    return run_available(pairing.pair(_messages(spark, sf), "queued", ("conn_id", "corr_id"), keep_ms=400 * 86_400_000))


#: Two days in nanoseconds, for which a request and its responses belong together.
_KEEP = 172_800_000_000_000


@query("i4_pair_correlation", f"""SELECT * FROM (WITH RECURSIVE rounds AS (SELECT conn_id, corr_id, min(ts_ns) AS t FROM messages WHERE is_req GROUP BY ALL UNION ALL
 SELECT r.conn_id, r.corr_id, (SELECT min(q.ts_ns) FROM messages q WHERE q.is_req AND q.conn_id = r.conn_id AND q.corr_id = r.corr_id AND q.ts_ns > r.t + {_KEEP}) AS t FROM rounds r WHERE t IS NOT NULL)
 SELECT r.conn_id, r.corr_id, r.t AS req_ts, max(struct_pack(a := m.ts_ns, b := m.seq)).a AS resp_ts, (SELECT min(q.seq) FROM messages q WHERE q.is_req AND q.conn_id = r.conn_id AND q.corr_id = r.corr_id AND q.ts_ns = r.t) AS req_seq, max(struct_pack(a := m.ts_ns, b := m.seq)).b AS resp_seq
 FROM rounds r JOIN messages m ON m.conn_id = r.conn_id AND m.corr_id = r.corr_id AND NOT m.is_req AND m.ts_ns BETWEEN r.t AND r.t + {_KEEP} WHERE r.t + {_KEEP} < {_PASSED} GROUP BY r.conn_id, r.corr_id, r.t)""", (MESSAGES,))
def i4a_correlation(spark, sf):
    """The first request of an id and the last response of the two days after it; then the next request."""
    return run_available(pairing.pair(_messages(spark, sf), "correlation", ("conn_id", "corr_id"), keep_ms=_KEEP // 1_000_000))


@query("g5_stream_order", f"SELECT user_id % 4 AS lane, row_number() OVER (PARTITION BY user_id % 4 ORDER BY start_ns, record_id, protocol, request) - 1 AS position, start_ns, record_id, protocol, request FROM records WHERE start_ns <= (SELECT max(start_ns) // 1000000 * 1000000 FROM records) - 1000000000", (RECORDS,))
def g5_stream(spark, sf):
    """Records of four lanes, numbered as they leave."""
    rows = _records(spark, sf).withColumn("lane", c("user_id") % 4)
    return run_available(order.in_request_order(rows, ["record_id", "protocol", "request"], lane="lane"), stateful=True)


@query("i6_latest_events", """SELECT conn_id, least(count(*), 3) AS held, greatest(count(*) - 3, 0) AS dropped, list_sort(list(ts_ns), 'DESC')[least(count(*), 3)] AS first_ns, max(ts_ns) AS last_ns FROM messages GROUP BY conn_id
 HAVING max(ts_ns) // 1000000 + 15000 <= (SELECT max(ts_ns) // 1000000 FROM messages) - 1000""", (MESSAGES,))
def i6(spark, sf):
    """The three latest messages of each connection that is idle."""
    return run_available(pairing.latest_events(_messages(spark, sf), ("conn_id",), 3))


@query("i8_stuck_heads", f"""SELECT conn_id, s AS start, s + byte_size AS "end", ts_ns AS last_ns FROM (SELECT *, row_number() OVER (PARTITION BY conn_id ORDER BY ts_ns, seq) * 1000 AS s FROM messages) WHERE ts_ns + 1000000000 < {_PASSED}""", (MESSAGES,))
def i8_heads(spark, sf):
    """Each message of a connection begins at a thousand times its number, so that every range has a gap behind it."""
    order = F.row_number().over(Window.partitionBy("conn_id").orderBy("ts_ns", "seq"))
    numbers = adapters.messages(spark, sf).select("seq", (order * 1000).cast("long").alias("begin"))
    rows = _messages(spark, sf).join(numbers, "seq").select("conn_id", F.col("begin").alias("seq"), F.col("byte_size").cast("long").alias("len"), "ts_ns")
    return run_available(pairing.stuck_heads(rows))


@query("i5_deduplicated", "SELECT DISTINCT user_id, k FROM events_v WHERE event_type = 'view'", (EVENTS,))
def i5(spark, sf):
    e = adapters.events_of(adapters.stream(spark, sf, "events")).where("event_type = 'view'").withColumn("event_time", event_time("ts_ns"))
    return run_available(stats.deduplicated(e, ["user_id", "k"], "400 days").select("user_id", "k"))


@query("i5_late_and_double", "SELECT event_id, user_id, ts_ns FROM events_v WHERE event_id % 10 <> 0 OR ts_ns > (SELECT max(ts_ns) // 1000000 * 1000000 FROM events_v WHERE event_id % 10 > 1) - 86400000000000", (EVENTS,))
def i5_late(spark, sf):
    """Three batches and a watermark of a day: every tenth event comes with the last batch, and every seventh comes again. What is older than
    the watermark of the first batch by then is late and goes (Spark filters by the watermark of the batch before), as do the copies."""
    path = scratch(spark)
    e = adapters.events(spark, sf).select("event_id", "user_id", "ts_ns")
    digit = c("event_id") % 10
    for part in (e.where(digit > 1), e.where(digit == 1), e.where((digit == 0) | (c("event_id") % 7 == 0))):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    rows = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").withColumn("event_time", event_time("ts_ns"))
    return run_available(stats.deduplicated(rows, ["event_id"], "1 day").select("event_id", "user_id", "ts_ns"))


@query("i7_closed_connections", """SELECT conn_id, min(ts_ns) AS start_ns, max(ts_ns) AS last_ns, CAST(sum(byte_size) AS BIGINT) AS bytes FROM messages GROUP BY conn_id
 HAVING max(ts_ns) // 1000000 + CASE WHEN bool_or(event_type = 'error') THEN 100 ELSE 15000 END <= (SELECT max(ts_ns) // 1000000 FROM messages) - 1000""", (MESSAGES,))
def i7(spark, sf):
    return run_available(pairing.closed_connections(_messages(spark, sf).withColumn("closes", c("event_type") == "error")))


@query("i8_stale_heads", "SELECT conn_id, min(ts_ns) AS start_ns, max(ts_ns) AS last_ns, CAST(sum(byte_size) AS BIGINT) AS bytes FROM messages GROUP BY conn_id HAVING max(ts_ns) // 1000000 + 1000 <= (SELECT max(ts_ns) // 1000000 FROM messages) - 1000", (MESSAGES,))
def i8(spark, sf):
    return run_available(pairing.stale_heads(_messages(spark, sf)))


@query("i9_top_samples", "SELECT CAST(protocol AS VARCHAR) AS class_id, record_id, CAST(resp_size AS DOUBLE) AS value, start_ns FROM records QUALIFY row_number() OVER (PARTITION BY protocol ORDER BY resp_size DESC, start_ns, record_id) <= 5", (RECORDS,))
def i9(spark, sf):
    path = scratch(spark)
    rows = batch_stats._base(_records(spark, sf), "respsize").select(batch_stats.CLASSIFIERS["protocol"]().alias("class_id"), "record_id", c("_value").alias("value"), "start_ns")
    q = stats.keep_top(rows, f"{path}/top", f"{path}/state", 5).trigger(availableNow=True).start()
    q.awaitTermination()
    versions = spark.read.schema(rows.schema.add("v", "long")).parquet(f"{path}/top")
    last = versions.agg(F.max("v")).first()[0]
    return versions.where(c("v") == F.lit(last)).drop("v")


#: Segments of a user's messages, by their number n in order of time: neighbours come in the wrong order, some twice; seq wraps after 20
#: of them, and jumps by two MiB after every 50. The last message closes the connection.
_SLOT = "CASE WHEN k % 10 = 0 THEN n // 2 * 2 + 1 ELSE n // 2 * 2 + 1 - n % 2 END"
_STREAM_SEGMENTS = MESSAGES + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY conn_id ORDER BY ts_ns, seq) - 1 AS n FROM messages),
stream_0 AS (SELECT conn_id, n AS arrival, byte_size AS len, {_SLOT} AS slot FROM numbered), stream_1 AS (SELECT *, slot >= 20 AS wrapped, slot // 50 AS jump, (4294965296 + slot * 100 + slot // 50 * 2097152) % 4294967296 AS seq FROM stream_0),
stream_2 AS (SELECT * FROM stream_1 QUALIFY row_number() OVER (PARTITION BY conn_id, wrapped, jump, seq ORDER BY arrival) = 1)"""


def _stream_segments(spark, sf):
    messages = adapters.messages(spark, sf)
    order = Window.partitionBy("conn_id").orderBy("ts_ns", "seq")
    last = F.lead("seq").over(order).isNull()
    numbers = messages.select("seq", (F.row_number().over(order) - 1).alias("n"), "k", last.alias("closes"))
    pair = F.floor(c("n") / 2).cast("long") * 2 + 1
    slot = F.when(c("k") % 10 == 0, pair).otherwise(pair - c("n") % 2)
    rows = _messages(spark, sf).join(numbers, "seq").withColumn("slot", slot)
    seq = (F.lit(4294965296) + c("slot") * 100 + F.floor(c("slot") / 50).cast("long") * 2097152) % F.lit(1 << 32)
    return rows.select("conn_id", F.lit("in").alias("direction"), seq.alias("seq"), c("byte_size").alias("len"), F.expr("ts_ns div 1000000 * 1000000").alias("ts_ns"), c("n").cast("long").alias("arrival"), "closes")


@query("f1_i6_i8_stream", """SELECT conn_id, epoch, start, "end", segments, bytes, CASE WHEN last_epoch = epoch THEN 'close' WHEN NOT wrapped AND wraps THEN 'wrap' ELSE 'gap' END AS reason FROM (
 SELECT *, max(epoch) OVER (PARTITION BY conn_id) AS last_epoch, bool_or(wrapped) OVER (PARTITION BY conn_id) AS wraps FROM (SELECT conn_id, wrapped, dense_rank() OVER (PARTITION BY conn_id ORDER BY wrapped, jump) - 1 AS epoch, min(seq) AS start, max(seq + len) AS "end", count(*) AS segments, CAST(sum(len) AS BIGINT) AS bytes FROM (
 SELECT *, sum(CASE WHEN reach IS NULL OR seq > reach THEN 1 ELSE 0 END) OVER (PARTITION BY conn_id, wrapped, jump ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(seq + len) OVER (PARTITION BY conn_id, wrapped, jump ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stream_2)) GROUP BY conn_id, wrapped, jump, island))""", (_STREAM_SEGMENTS,))
def f1_stream(spark, sf):
    """Streams that wrap and jump, put together as they come in; no head is given up."""
    out = run_available(reassembly.ranges(_stream_segments(spark, sf), stuck_ms=4000 * 86_400_000, delay="0 seconds"), stateful=True)
    return out.select("conn_id", "epoch", "start", "end", "segments", "bytes", "reason")


#: A user's messages as a timeline: of each eight in a row seven are packets, in bytes of their own, and the eighth is the pair that has
#: carried them. Every eleventh k comes three pairs late, every thirteenth is seen twice; a third of the users speak TLS.
_TIMELINE = f"""numbered AS (SELECT *, (row_number() OVER w - 1) // 8 AS m, (row_number() OVER w - 1) % 8 AS j FROM messages WINDOW w AS (PARTITION BY conn_id ORDER BY ts_ns, seq)),
pk AS (SELECT conn_id, ({list(_E10_STEPS)})[(j + m) % {len(_E10_STEPS)} + 1] AS step, m * 100 + j * 10 + k % 7 - CASE WHEN k % 11 = 0 AND m >= 3 THEN 300 ELSE 0 END AS seq, 5 + k % 20 AS len, ts_ns + 500 * u.c AS ts_ns, k AS ts_delta, CASE WHEN u.c = 0 THEN 'eth' || (k % 3) ELSE 'eth9' END AS ifname
 FROM numbered, (VALUES (0), (1)) u(c) WHERE j < 7 AND (u.c = 0 OR k % 13 = 0)),
pairs_0 AS (SELECT conn_id, m AS pair_id, CASE WHEN conn_id % 2 = 0 THEN 'client' ELSE 'server' END AS side, conn_id % 3 = 0 AS is_ssl, ts_ns - 1000 * (100 + k) AS req_ts, ts_ns AS resp_ts, k % 5 <> 0 AS maps, m * 100 AS b FROM numbered WHERE j = 7),
pairs AS (SELECT conn_id, pair_id, side, is_ssl, CASE WHEN is_ssl THEN maps END AS req_maps, CASE WHEN is_ssl THEN maps END AS resp_maps, req_ts, resp_ts, CASE WHEN is_ssl THEN b + 5 ELSE b + 3 END AS q_start, CASE WHEN is_ssl THEN b + 40 + CASE WHEN maps THEN 30 ELSE 0 END ELSE b + 53 END AS q_end,
 CASE WHEN is_ssl THEN b + 5 ELSE b + 23 END AS r_start, CASE WHEN is_ssl THEN b + 40 + CASE WHEN maps THEN 30 ELSE 0 END ELSE b + 83 END AS r_end FROM pairs_0),
kept AS (SELECT * FROM pk WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.conn_id = pk.conn_id AND p.resp_ts + 1000000000 < pk.ts_ns AND CASE WHEN (pk.step <= {names.LAST_EGRESS}) = (p.side = 'client') THEN q_end ELSE r_end END > pk.seq)),
nics AS (SELECT conn_id, step, seq, CASE WHEN step IN (6, 7, 8, 9) THEN ifname END AS nic, min(struct_pack(t := ts_ns, l := len, d := ts_delta)) AS e FROM kept GROUP BY ALL), evs AS (SELECT conn_id, step, seq, min(e) AS e, max(e.t) AS last_ns FROM nics GROUP BY ALL),
ev AS (SELECT p.conn_id, p.pair_id, p.side, step > {names.LAST_EGRESS} AS comes_in, step, seq, e.t AS ts_ns, e.t + e.d AS end_ns, e.t AS first_ns, last_ns FROM evs v JOIN pairs p ON p.conn_id = v.conn_id
 AND CASE WHEN (step <= {names.LAST_EGRESS}) = (p.side = 'client') THEN seq < q_end AND seq + e.l > q_start ELSE seq < r_end AND seq + e.l > r_start END)"""


def _timeline(spark, sf):
    messages = adapters.messages(spark, sf)
    n = F.row_number().over(Window.partitionBy("conn_id").orderBy("ts_ns", "seq")) - 1
    numbers = messages.select("seq", F.floor(n / 8).cast("long").alias("m"), (n % 8).alias("j"), "k")
    rows = _messages(spark, sf).join(numbers, "seq")
    b, k, at = c("m") * 100, c("k"), c("ts_ns")
    types = {name: kind for name, kind in annotate.TIMELINE.items() if name != "conn_id"}
    row = lambda **made: F.struct(*(made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in types.items()))
    step = F.get(F.array(*[F.lit(x) for x in _E10_STEPS]), ((c("j") + c("m")) % len(_E10_STEPS)).cast("int"))
    packet = lambda copy: row(ts_ns=at + 500 * copy, kind=F.lit("packet"), step=step, seq=b + c("j") * 10 + k % 7 - F.when((k % 11 == 0) & (c("m") >= 3), 300).otherwise(0), len=5 + k % 20, ts_delta=k,
                              ifname=F.lit("eth9") if copy else F.concat(F.lit("eth"), (k % 3).cast("string")))
    tls = lambda egress, second: row(ts_ns=at - 1000, kind=F.lit("tls"), egress=F.lit(egress), seq=b + (45 if second else 25), len=F.lit(10), syscall_seq=b + (40 if second else 5),
                                     syscall_len=F.when(k % 5 != 0, 30).otherwise(0) if second else F.lit(30))
    side, ssl = F.when(c("conn_id") % 2 == 0, "client").otherwise("server"), c("conn_id") % 3 == 0
    pair = row(ts_ns=at, kind=F.lit("pair"), pair_id=c("m"), side=side, is_ssl=ssl, req_ts=at - 1000 * (100 + k), req_start=b + 3, req_end=b + 53, resp_start=b + 23, resp_end=b + 83)
    all_tls = [tls(egress, second) for egress in (True, False) for second in (True, False)]
    made = F.when(c("j") < 7, F.when(k % 13 == 0, F.array(packet(0), packet(1))).otherwise(F.array(packet(0)))).when(ssl, F.array(pair, *all_tls)).otherwise(F.array(pair))
    return rows.select("conn_id", F.explode(made).alias("row")).select("conn_id", "row.*")


def _e10_stream(name, devices=True, sockets=True):
    @query(name, _e10_sql(devices, sockets, _TIMELINE) + f" WHERE pair_id IS NOT NULL AND (conn_id, pair_id) IN (SELECT (conn_id, m) FROM (SELECT conn_id, (row_number() OVER (PARTITION BY conn_id ORDER BY ts_ns, seq) - 1) // 8 AS m, (row_number() OVER (PARTITION BY conn_id ORDER BY ts_ns, seq) - 1) % 8 AS j, ts_ns FROM messages) WHERE j = 7 AND ts_ns + 1000000000 < {_PASSED})", (MESSAGES,))
    def run(spark, sf):
        rows = annotate.annotated(_timeline(spark, sf), devices, sockets, idle_ms=4000 * 86_400_000)
        return run_available(rows.select("conn_id", "pair_id", "side", "start_ns", "end_ns", "total_ns", "black_box_ns", "read_socket_ns", "copy_to_sock_ns"), stateful=True)


_e10_stream("e10_i5_stream")
_e10_stream("e10_i5_stream_untraced", False, False)
