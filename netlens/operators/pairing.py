"""Requests and responses become pairs. Every rule is a window or an equi-join inside (connection, stream or id).

Rules that take `blocks` run a group in one task without it; with it a long group is cut into blocks (scan.running), with equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.operators import scan
from netlens.operators.scratch import written

c = F.col
_PAIR = ("conn_id", "req_ts", "resp_ts", "req_seq", "resp_seq")


def _paired(rows: DataFrame, keys: list[str], tie: str, blocks: int | None = None) -> DataFrame:
    """A response whose predecessor is a request takes it; a response resets what is pending."""
    first = c("is_req").cast("int") if tie == "response" else -c("is_req").cast("int")
    if blocks:
        out = scan.previous(rows, keys, ["ts_ns", first, "seq"], ["is_req", "ts_ns", "seq", "byte_size"], "_q", blocks).where(~c("is_req") & c("_q.is_req"))
        return out.select(*keys, c("_q.ts_ns").alias("req_ts"), c("ts_ns").alias("resp_ts"), c("_q.seq").alias("req_seq"), c("seq").alias("resp_seq"), c("_q.byte_size").alias("req_size"), c("byte_size").alias("resp_size"))
    w = Window.partitionBy(*keys).orderBy("ts_ns", first, "seq")
    lag = lambda x: F.lag(x).over(w)
    out = rows.withColumns({"_was_req": lag("is_req"), "req_ts": lag("ts_ns"), "req_seq": lag("seq"), "req_size": lag("byte_size")})
    return out.where(~c("is_req") & c("_was_req")).select(*keys, "req_ts", c("ts_ns").alias("resp_ts"), "req_seq", c("seq").alias("resp_seq"), "req_size", c("byte_size").alias("resp_size"))


def pair_fifo(messages: DataFrame, blocks: int | None = None) -> DataFrame:
    """Each response takes the latest request since the response before it; older requests of a run and orphan responses go. At equal
    times the response comes first."""
    return _paired(messages, ["conn_id"], "response", blocks)


def pair_by_stream(messages: DataFrame, blocks: int | None = None) -> DataFrame:
    """As pair_fifo inside each stream, but at equal times the request comes first."""
    return _paired(messages, ["conn_id", "stream_id"], "request", blocks)


def pair_by_correlation(messages: DataFrame, keys: tuple[str, ...] = ("conn_id", "corr_id")) -> DataFrame:
    """The first request and the last response of an id, if the request is not later."""
    pairs = _by_id(messages, list(keys), first_request=True, last_response=True)
    return pairs.where("req_ts <= resp_ts")


def pair_by_opaque(messages: DataFrame, keys: tuple[str, ...] = ("conn_id", "corr_id")) -> DataFrame:
    """The last request and the first response of an id, whatever their times."""
    return _by_id(messages, list(keys), first_request=False, last_response=False)


def _by_id(messages: DataFrame, keys: list[str], first_request: bool, last_response: bool) -> DataFrame:
    """One aggregate that combines before the shuffle: an id with however many messages is two rows in each task."""
    one = lambda side, first: (F.min if first else F.max)(F.when(side, F.struct("ts_ns", "seq", "byte_size")))
    rows = messages.dropna(subset=keys).groupBy(*keys).agg(one(c("is_req"), first_request).alias("_q"), one(~c("is_req"), not last_response).alias("_r")).where("_q is not null and _r is not null")
    return rows.select(*keys, c("_q.ts_ns").alias("req_ts"), c("_q.seq").alias("req_seq"), c("_q.byte_size").alias("req_size"), c("_r.ts_ns").alias("resp_ts"), c("_r.seq").alias("resp_seq"), c("_r.byte_size").alias("resp_size"))


def pair_queued(messages: DataFrame, keys: tuple[str, ...] = ("conn_id", "stream_id"), blocks: int | None = None) -> DataFrame:
    """Each response takes the earliest request that still waits under its id; requests come first at equal times. A response that
    finds none waiting is an orphan: the running balance reaches a new low below zero there."""
    keys, order = list(keys), ["ts_ns", F.lit(1) - c("is_req").cast("int"), "seq"]
    rows = scan.running(messages, keys, order, {"_c": ("sum", 2 * c("is_req").cast("int") - 1, True)}, blocks)
    rows = scan.running(rows, keys, order, {"_low": ("min", c("_c"), False)}, blocks)
    rows = rows.withColumn("_low", F.least(F.coalesce("_low", F.lit(0)), F.lit(0)))
    numbered = lambda some: scan.running(some, keys, ["ts_ns", "seq"], {"_n": ("sum", F.lit(1), True)}, blocks)
    req = numbered(rows.where("is_req")).select(*keys, "_n", c("ts_ns").alias("req_ts"), c("seq").alias("req_seq"))
    resp = numbered(rows.where(~c("is_req") & (c("_c") >= c("_low")))).select(*keys, "_n", c("ts_ns").alias("resp_ts"), c("seq").alias("resp_seq"))
    return req.join(resp, [*keys, "_n"]).drop("_n")


def stitch_chains(responses: DataFrame) -> DataFrame:
    """Responses that continue one another (response_to = request_id of the one before, while more_to_come) as one: head_id, frames,
    byte_size, body (each frame's body and a blank, in order).

    Chains are followed to their end, however long: each round joins a frame's way to an earlier frame with that one's own way, so
    ways double, and rounds grow with the logarithm of the longest chain. Frames whose way is a circle have no head and go.
    """
    spark = responses.sparkSession
    frames = responses.select("conn_id", "request_id", "response_to", "more_to_come", "byte_size", "body")
    before = frames.where("more_to_come").select("conn_id", c("request_id").alias("response_to"), F.lit(True).alias("_goes_on")).distinct()
    goes_on = c("_goes_on").isNotNull()
    # up is where a frame's way ends so far, depth the frames on it; a way that has reached a head has no up
    ways = frames.join(before, ["conn_id", "response_to"], "left").select(
        "conn_id", "request_id", "more_to_come", "byte_size", "body", F.when(goes_on, c("response_to")).alias("up"),
        F.when(~goes_on, c("request_id")).alias("head_id"), goes_on.cast("long").alias("depth"), goes_on.alias("is_open"))
    ways = written(ways, "ways")
    most, reach = ways.count(), 1
    while reach <= 2 * most and ways.where("is_open").limit(1).count():
        further = ways.where("more_to_come").select("conn_id", c("request_id").alias("up"), c("up").alias("_up"), c("head_id").alias("_head"), c("depth").alias("_depth"), c("is_open").alias("_open"))
        moved = ways.where("is_open").join(further, ["conn_id", "up"]).select(
            "conn_id", "request_id", "more_to_come", "byte_size", "body", c("_up").alias("up"), c("_head").alias("head_id"), (c("depth") + c("_depth")).alias("depth"), c("_open").alias("is_open"))
        ways, reach = written(ways.where("not is_open").unionByName(moved), "ways"), 2 * reach
    done = ways.where("not is_open")
    return spark.sql("SELECT conn_id, head_id, count(*) AS frames, sum(byte_size) AS byte_size, listagg(body || ' ') WITHIN GROUP (ORDER BY depth, request_id) AS body FROM {done} GROUP BY conn_id, head_id", done=done)


def group_response_runs(packets: DataFrame, blocks: int | None = None) -> DataFrame:
    """Responses between a request and the next one, as far as their packet ids run 1, 2, 3 ... (a byte that wraps): req_seq, packets,
    resp_size, and the status that the first packet's head decides (0 OK: success, 255 ERR: fail, else a result set: unknown)."""
    rows = scan.running(packets, ["conn_id"], ["ts_ns", c("is_req").cast("int"), "seq"], {"req_seq": ("last", F.when(c("is_req"), c("seq")), True)}, blocks)
    rows = rows.where(~c("is_req") & c("req_seq").isNotNull())
    run = Window.partitionBy("conn_id", "req_seq").orderBy("ts_ns", "seq")
    rows = rows.withColumn("_n", F.row_number().over(run)).withColumn("_fits", (c("packet_id") == c("_n") % 256).cast("int"))
    rows = rows.withColumn("_all", F.min("_fits").over(run.rowsBetween(Window.unboundedPreceding, 0))).where("_all = 1")
    status = F.when(F.min_by("head", "_n") == 0, F.lit(1)).when(F.min_by("head", "_n") == 255, F.lit(2)).otherwise(F.lit(3))
    return rows.groupBy("conn_id", "req_seq").agg(F.count(F.lit(1)).alias("packets"), F.sum("byte_size").alias("resp_size"), F.max("ts_ns").alias("resp_ts"), status.cast("int").alias("status"))


def join_statements(commands: DataFrame) -> DataFrame:
    """EXECUTE commands with the text of the latest PREPARE of their statement that is not closed. commands(conn_id, stmt_id, ts_ns, seq,
    command in prepare, execute, close; body; params)."""
    w = Window.partitionBy("conn_id", "stmt_id").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(c("command") == "prepare", F.struct(c("body").alias("query"))).when(c("command") == "close", F.struct(F.lit(None).cast("string").alias("query")))
    rows = commands.withColumn("_query", F.last(state, ignorenulls=True).over(w)["query"]).where(c("command") == "execute")
    text = F.concat(F.lit("query=["), c("_query"), F.lit("] params=["), F.array_join("params", ", "), F.lit("]"))
    return rows.select("conn_id", "stmt_id", "ts_ns", "seq", F.coalesce(text, F.concat(F.lit("Execute stmt_id="), c("stmt_id").cast("string"), F.lit("."))).alias("text"))


def unmatched(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(conn_id, requests, responses) that no pair has."""
    req = messages.where("is_req").join(pairs.select("conn_id", c("req_seq").alias("seq")), ["conn_id", "seq"], "left_anti")
    resp = messages.where("not is_req").join(pairs.select("conn_id", c("resp_seq").alias("seq")), ["conn_id", "seq"], "left_anti")
    return req.select("conn_id", "is_req").unionByName(resp.select("conn_id", "is_req")).groupBy("conn_id").agg(F.count_if("is_req").alias("requests"), F.count_if(~c("is_req")).alias("responses"))
