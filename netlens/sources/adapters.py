"""Views of the benchmark tables as records, messages, events and dimensions: deterministic, and the same in SQL (plans.oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlens.operators.scratch import parts_of
from netlens.sources.readers import epoch_ns

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a, b: int):
    """Whole-number division of a column that is not negative."""
    return F.floor(a / F.lit(b)).cast("long")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(table(spark, sf_dir, "events"))


def events_of(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "user_id", "event_type", "value", epoch_ns(c("ts")).alias("ts_ns"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def _pick(column, values):
    return F.get(F.array(*[F.lit(v) for v in values]), column.cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated records, one for each event."""
    return records_of(events(spark, sf_dir))


def records_of(e: DataFrame) -> DataFrame:
    k, i = c("k"), c("event_id")
    protocol = F.when(c("event_type") == "view", 2).when(c("event_type") == "click", 8).when(c("event_type") == "purchase", 4).when(c("event_type") == "signup", 11).otherwise(7)
    e = e.withColumns({"protocol": protocol.cast("int"), "total": F.round(c("value") * 100).cast("long") * 10000})
    path = F.concat(F.lit("/p"), (k % 10).cast("string"), F.lit("/i"), (k % 3).cast("string"))
    command = _pick(k % 4, ["GET", "SET", "HGETALL", "CLIENT LIST"])
    payload = F.concat(F.lit("key"), (k % 13).cast("string"), F.lit(" v"), (i % 5).cast("string"))
    method, host = _pick(k % 3, ["GET", "POST", "HEAD"]), F.concat(F.lit("h"), (k % 6).cast("string"), F.lit(".example.com"))
    topic = lambda x: F.array(F.concat(F.lit("t"), (x % 5).cast("string")), F.concat(F.lit("t"), (x % 3).cast("string")))
    request = F.when(c("protocol") == 2, F.concat(method, F.lit(" "), path, F.lit(" "), host)).when(c("protocol") == 8, F.concat(command, F.lit(" "), payload)).otherwise(F.concat(F.lit("req "), k.cast("string")))
    return e.select(
        i.alias("record_id"), c("user_id"), F.concat_ws("|", F.concat(F.lit("10.0.0."), (c("user_id") % 16).cast("string")), (30000 + c("user_id")).cast("string"), F.concat(F.lit("192.168."), (c("user_id") % 8).cast("string"), F.lit("."), (k % 10).cast("string")), (8000 + c("protocol")).cast("string")).alias("conn_id"),
        F.concat(F.lit("10.0.0."), (c("user_id") % 16).cast("string")).alias("local_addr"), (30000 + c("user_id")).cast("int").alias("local_port"),
        F.concat(F.lit("192.168."), (c("user_id") % 8).cast("string"), F.lit("."), (k % 10).cast("string")).alias("remote_addr"), (8000 + c("protocol")).cast("int").alias("remote_port"),
        (1000 + c("user_id") % 20).alias("pid"), "protocol", F.when(i % 2 == 0, "server").otherwise("client").alias("side"), (i % 5 == 0).alias("is_ssl"),
        c("ts_ns").alias("start_ns"), (c("ts_ns") + c("total")).alias("end_ns"), c("total").alias("total_ns"), F.when(i % 7 != 0, _div(c("total"), 10) * 6).alias("black_box_ns"), F.when(i % 11 != 0, _div(c("total"), 10) * 2).alias("read_socket_ns"),
        F.when(i % 13 != 0, _div(c("total"), 10)).alias("copy_to_sock_ns"), (64 + k).alias("req_size"), ((k * 137 + i) % 9973).alias("resp_size"), F.when(i % 5 == 0, 64 + k - 20).alias("req_plain_size"), F.when(i % 5 == 0, (k * 137 + i) % 9973).alias("resp_plain_size"),
        request.alias("request"), F.concat(F.lit("resp "), i.cast("string")).alias("response"), F.when(i % 17 == 0, 2).otherwise(1).cast("int").alias("response_status"),
        F.when(c("protocol") == 2, F.struct(method.alias("method"), path.alias("path"), host.alias("host"))).alias("http"), F.when(c("protocol") == 8, F.struct(command.alias("command"), payload.alias("payload"))).alias("redis"),
        F.when(c("protocol") == 11, F.struct((k % 3).cast("int").alias("api_key"), topic(k).alias("req_topics"), topic(k + 1).alias("resp_topics"))).alias("kafka"),
        F.when(c("protocol") == 4, F.struct((10 + k % 3).cast("int").alias("request_code"), (k % 14).cast("int").alias("language"))).alias("rocketmq"),
        F.when(c("protocol") == 7, F.struct((k % 7).cast("int").alias("txid"), F.array(host, F.concat(F.lit("alias."), host)).alias("names"))).alias("dns"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages on one stream for each user; views, clicks and signups are requests."""
    e, k = events(spark, sf_dir), c("k")
    order = Window.partitionBy("user_id").orderBy("ts_ns", "event_id")
    return e.select(c("user_id").alias("conn_id"), c("event_type").isin("view", "click", "signup").alias("is_req"), "ts_ns", c("event_id").alias("seq"), (64 + k).alias("byte_size"), (k % 9).alias("stream_id"), (k % 25).alias("corr_id"),
                    F.row_number().over(order).cast("int").alias("packet_id"), c("event_id").alias("request_id"), F.concat(F.lit("m"), k.cast("string")).alias("body"), "event_type", (k % 4).alias("stmt_id"), "k")


def kern_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet events: the lines of an order are adjacent byte ranges of a connection."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
    rows = table(spark, sf_dir, "lineitem").select("*", F.row_number().over(order).alias("rn"), F.round(c("l_quantity")).cast("long").alias("len"))
    before = F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(c("l_orderkey").alias("conn_id"), c("rn").cast("int").alias("rn"), (c("l_linenumber") % 14 + 1).cast("int").alias("step"), before.alias("seq"), "len",
                       (epoch_ns(c("l_shipdate")) + c("l_partkey") * 1000).alias("ts_ns"), F.concat(F.lit("eth"), (c("l_suppkey") % 3).cast("string")).alias("ifname"), (c("l_partkey") % 32).cast("int").alias("flags"))


def message_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of messages: every three packets of a connection, seen from its second packet on, so that ranges cut packets."""
    k = kern_events(spark, sf_dir)
    g = k.groupBy("conn_id", _div(c("rn") - 1, 3).cast("int").alias("message")).agg(F.min("seq").alias("lo"), F.max(c("seq") + c("len")).alias("hi"))
    return g.select("conn_id", "message", (c("lo") + 5).alias("start"), (c("hi") + 5).alias("end"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured byte ranges with gaps and overlaps; arrival is the order of the ship dates."""
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.repartition(parts_of(rows), "l_orderkey")
    arrival = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber", "l_discount", "l_tax")
    return rows.select(c("l_orderkey").alias("conn_id"), F.lit("in").alias("direction"), (c("l_linenumber") * 25).cast("long").alias("seq"), F.round(c("l_quantity")).cast("long").alias("len"), F.row_number().over(arrival).cast("long").alias("arrival"), epoch_ns(c("l_shipdate")).alias("ts_ns"))


def conn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's signups open and errors close a connection; views tell its protocol."""
    e = events(spark, sf_dir)
    kind = F.when(c("event_type") == "signup", "connect").when(c("event_type") == "error", "close").when(c("event_type") == "view", "protocol_infer")
    return e.withColumn("kind", kind).where("kind is not null").select(c("user_id").alias("tgid_fd"), "kind", "ts_ns", c("event_id").alias("seq"), (c("k") % 15).cast("int").alias("protocol"), F.when(c("k") % 2 == 0, "server").otherwise("client").alias("role"))


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with labels as JSON text, as they are read."""
    k = c("c_custkey")
    labels = F.concat(F.lit('{"io.kubernetes.pod.name":"pod-'), (k % 50).cast("string"), F.lit('","io.kubernetes.pod.namespace":"'), F.lower("c_mktsegment"), F.when(k % 10 == 0, F.lit('","io.kubernetes.docker.type":"podsandbox"}')).otherwise(F.lit('"}')))
    return table(spark, sf_dir, "customer").select(F.md5(F.concat(F.lit("c"), k.cast("string"))).alias("id"), F.concat(F.lit("/"), F.lower("c_name")).alias("name"), labels.alias("labels"), (1000 + k % 200).alias("root_pid"),
                                                   F.when(k % 23 != 0, 4026531000 + k % 97).otherwise(F.lit(0)).cast("long").alias("pid_ns"), F.when(k % 23 != 0, 4026532000 + k % 89).otherwise(F.lit(0)).cast("long").alias("mnt_ns"), F.when(k % 23 != 0, 4026533000 + k % 83).otherwise(F.lit(0)).cast("long").alias("net_ns"), F.lit("image").alias("image"))


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c("p_partkey")
    return table(spark, sf_dir, "part").select(p.alias("pid"), F.when(p > 0, _div(p, 3)).alias("ppid"), F.concat(F.lit("/usr/bin/"), F.regexp_replace("p_name", " ", "-")).alias("name"), (4026533000 + p % 83).alias("net_ns"))


def nat_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("10.0.0."), (s % 16).cast("string")).alias("sip"), (30000 + s).cast("int").alias("sport"), F.concat(F.lit("192.168."), (s % 8).cast("string"), F.lit("."), (s % 10).cast("string")).alias("dip"), F.lit(8002).alias("dport"),
                                                   F.concat(F.lit("172.16."), c("s_nationkey").cast("string"), F.lit(".1")).alias("to_sip"), (40000 + s).cast("int").alias("to_sport"), F.concat(F.lit("10.9.8."), (s % 200).cast("string")).alias("to_dip"), F.lit(80).alias("to_dport"))
