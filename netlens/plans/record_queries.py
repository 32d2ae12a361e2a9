"""Queries over annotated records: projections, filters, statistics, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions import histogram, names, scalars, sql
from netlens.operators import bodies, enrich, filters, hops, rollups, stats, watch
from netlens.operators.filters import RecordFilter
from netlens.operators.scratch import scratch_path
from netlens.plans.oracle import CONTAINERS, EVENTS, KERN, MESSAGES, NAT, PROCESSES, RECORDS
from netlens.plans.registry import query
from netlens.plans.stat_query import StatQuery
from netlens.sources import adapters, readers

c = F.col


def _records(name: str, select: str, rest: str = ""):
    return query(name, f"SELECT {select} FROM records {rest}", (RECORDS,))


# --- sources and sinks -----------------------------------------------------------------------------------------------------
_EXPORTED = "SELECT start_ns, end_ns, CASE protocol WHEN 2 THEN 'HTTP' WHEN 8 THEN 'Redis' WHEN 4 THEN 'MySQL' WHEN 11 THEN 'Kafka' ELSE '' END AS protocol, side, local_addr, local_port, remote_addr, remote_port, pid, is_ssl, total_ns / 1e6 AS total_duration_ms, black_box_ns / 1e6 AS black_box_duration_ms, req_size AS req_size_bytes, resp_plain_size AS resp_plain_text_size_bytes, request, response FROM records"
_FIELDS = ["start_ns", "end_ns", "protocol", "side", "local_addr", "local_port", "remote_addr", "remote_port", "pid", "is_ssl", "total_duration_ms", "black_box_duration_ms", "req_size_bytes", "resp_plain_text_size_bytes", "request", "response"]


@query("a1_a2_exported_records", _EXPORTED, (RECORDS,))
def a1(spark, sf):
    """Records exported as JSON lines, in two appends, and read again."""
    path, rows = scratch_path(spark, "export"), adapters.records(spark, sf)
    for part in (0, 1):
        readers.write_records_json(rows.where(c("record_id") % 2 == part), path)
    return readers.read_records(spark, path).select(*_FIELDS)


# --- projections -----------------------------------------------------------------------------------------------------------
@_records("b1_milliseconds", "record_id, total_ns / 1e6 AS total_ms, black_box_ns / 1e6 AS black_box_ms")
def b1(spark, sf):
    return adapters.records(spark, sf).select("record_id", scalars.ns_to_ms(c("total_ns")).alias("total_ms"), scalars.ns_to_ms(c("black_box_ns")).alias("black_box_ms"))


_FRACTION = "regexp_replace(lpad(CAST(end_ns % 1000000000 AS VARCHAR), 9, '0'), '0+$', '')"


@_records("b2_time_text", f"record_id, strftime(make_timestamp(end_ns // 1000000000 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {_FRACTION} = '' THEN '' ELSE '.' || {_FRACTION} END || 'Z' AS rfc3339, strftime(make_timestamp(end_ns // 1000000000 * 1000000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(end_ns % 1000000000 // 1000000 AS VARCHAR), 3, '0') AS date_time, strftime(make_timestamp(end_ns // 1000000000 * 1000000), '%H:%M:%S') || '.' || lpad(CAST(end_ns % 1000000000 // 1000000 AS VARCHAR), 3, '0') AS clock")
def b2(spark, sf):
    return adapters.records(spark, sf).select("record_id", scalars.rfc3339_nano(c("end_ns")).alias("rfc3339"), scalars.date_time_ms(c("end_ns")).alias("date_time"), scalars.time_ms(c("end_ns")).alias("clock"))


@_records("b3_truncated", "record_id, CASE WHEN strlen(request) < 12 THEN request ELSE request[1:12] || '...(truncated, total: ' || strlen(request) || 'bytes)' END AS request")
def b3(spark, sf):
    return adapters.records(spark, sf).select("record_id", scalars.truncated(c("request"), 12).alias("request"))


@_records("b4_labels", "record_id, local_addr || ':' || local_port || CASE side WHEN 'client' THEN ' => ' ELSE ' <= ' END || remote_addr || ':' || remote_port AS label, local_addr || '|' || local_port || '|' || remote_addr || '|' || remote_port AS identity, "
          "CASE protocol WHEN 2 THEN 'HTTP' WHEN 8 THEN 'Redis' WHEN 4 THEN 'MySQL' WHEN 10 THEN 'Mongo' WHEN 14 THEN 'RocketMQ' WHEN 11 THEN 'Kafka' ELSE '' END AS protocol, CASE side WHEN 'server' THEN 'process internal duration' ELSE 'network duration' END AS black_box, CASE side WHEN 'server' THEN 'write' ELSE 'read' END AS response_syscall")
def b4(spark, sf):
    parts = c("local_addr"), c("local_port"), c("remote_addr"), c("remote_port")
    return adapters.records(spark, sf).select("record_id", scalars.connection_label(*parts, c("side")).alias("label"), scalars.connection_key(*parts).alias("identity"), names.protocol_name(c("protocol")).alias("protocol"), names.black_box_name(c("side")).alias("black_box"), names.syscall_name(c("side"), F.lit(False)).alias("response_syscall"))


@_records("b4c_side_names", "record_id % 3 AS code, CASE record_id % 3 WHEN 1 THEN 'server' WHEN 2 THEN 'client' ELSE 'all' END AS side, count(*) AS n", "GROUP BY ALL")
def b4c(spark, sf):
    code = c("record_id") % 3
    return adapters.records(spark, sf).groupBy(code.alias("code"), names.side_name(code).alias("side")).agg(F.count(F.lit(1)).alias("n"))


@_records("b5_pid_and_fd", "record_id, (pid * 4294967296 + record_id) >> 32 AS pid, (pid * 4294967296 + record_id) & 4294967295 AS fd")
def b5(spark, sf):
    packed = c("pid") * F.lit(1 << 32) + c("record_id")
    return adapters.records(spark, sf).select("record_id", scalars.pid_of(packed).alias("pid"), scalars.fd_of(packed).alias("fd"))


@_records("b6_displayed", "record_id, coalesce(printf('%.2f', black_box_ns / 1e6), '-') AS black_box")
def b6(spark, sf):
    return adapters.records(spark, sf).select("record_id", scalars.displayed(scalars.ns_to_ms(c("black_box_ns"))).alias("black_box"))


@query("b7_ip_text", "SELECT l_orderkey, l_linenumber, (l_orderkey % 256) || '.' || (l_partkey % 256) || '.' || (l_suppkey % 256) || '.' || (l_linenumber % 256) AS ip, count(*) AS n FROM lineitem GROUP BY ALL")
def b7(spark, sf):
    byte = lambda x: F.lpad(F.hex(c(x) % 256), 2, "0")
    raw = F.unhex(F.concat(byte("l_orderkey"), byte("l_partkey"), byte("l_suppkey"), byte("l_linenumber")))
    return adapters.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", scalars.ip_text(raw).alias("ip")).agg(F.count(F.lit(1)).alias("n"))


@query("b7_ipv6_text", """SELECT l_orderkey, l_linenumber, '2001:' || CASE l_linenumber % 3 WHEN 0 THEN format('{:x}:1:2:3:4:5:6', l_orderkey % 65535 + 1) WHEN 1 THEN format('{:x}::{:x}:a:b', l_orderkey % 65535 + 1, l_partkey % 65535 + 1) ELSE format('{:x}::', l_orderkey % 65535 + 1) END AS ip, count(*) AS n FROM lineitem GROUP BY ALL""")
def b7_v6(spark, sf):
    """Addresses without zeros, with zeros inside and with zeros at the end."""
    group = lambda x: F.lpad(F.hex(c(x) % 65535 + 1), 4, "0")
    rest = F.when(c("l_linenumber") % 3 == 0, F.lit("000100020003000400050006")).when(c("l_linenumber") % 3 == 1, F.concat(F.lit("000000000000"), group("l_partkey"), F.lit("000A000B"))).otherwise(F.lit("0" * 24))
    raw = F.unhex(F.concat(F.lit("2001"), group("l_orderkey"), rest))
    return adapters.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", scalars.ip_text(raw).alias("ip")).agg(F.count(F.lit(1)).alias("n"))


@query("b8_tcp_flags", "SELECT flags, concat_ws('|', CASE WHEN flags & 16 <> 0 THEN 'ACK' END, CASE WHEN flags & 8 <> 0 THEN 'PSH' END, CASE WHEN flags & 4 <> 0 THEN 'RST' END, CASE WHEN flags & 2 <> 0 THEN 'SYN' END) AS names, count(*) AS n FROM kern GROUP BY ALL", (KERN,))
def b8(spark, sf):
    return adapters.kern_events(spark, sf).groupBy(c("flags").cast("long").alias("flags"), names.tcp_flags(c("flags")).alias("names")).agg(F.count(F.lit(1)).alias("n"))


@_records("b9_dns_flags", "record_id, resp_size & 15 AS rcode, resp_size >> 8 & 1 AS rd, resp_size >> 11 & 15 AS opcode, resp_size >> 7 & 1 AS ra")
def b9(spark, sf):
    return adapters.records(spark, sf).select("record_id", *[scalars.dns_flag(c("resp_size"), *scalars.DNS_FLAGS[x]).alias(x) for x in ("rcode", "rd", "opcode", "ra")])


@query("b10_http_fields", "SELECT page_id, 'GET' AS method, split_part(regexp_replace(url, '^https?://[^/]*', ''), '?', 1) AS path, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages WHERE regexp_replace(url, '^https?://[^/]*', '') LIKE '/%'")
def b10(spark, sf):
    target = F.regexp_replace("url", "^https?://[^/]*", "")
    text = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", "^https?://([^/]*)", 1), F.lit("\r\n\r\n"))
    rows = adapters.table(spark, sf, "pages").where(target.startswith("/")).select("page_id", text.alias("t"))
    return rows.select("page_id", scalars.http_method(c("t")).alias("method"), scalars.http_path(c("t")).alias("path"), scalars.http_host(c("t")).alias("host"))


@query("b10_all_pages", "SELECT page_id, 'GET' AS method, split_part(CASE WHEN t LIKE '/%' THEN t ELSE '/' || t END, '?', 1) AS path, regexp_extract(url, '^https?://([^/?]*)', 1) AS host FROM (SELECT *, regexp_replace(url, '^https?://[^/?]*', '') AS t FROM pages)", ())
def b10_all(spark, sf):
    """Every page asked for, as a browser asks: a target that has no path begins with a slash."""
    target = F.regexp_replace("url", "^https?://[^/?]*", "")
    text = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", "^https?://([^/?]*)", 1), F.lit("\r\n\r\n"))
    rows = adapters.table(spark, sf, "pages").select("page_id", text.alias("t"))
    return rows.select("page_id", scalars.http_method(c("t")).alias("method"), scalars.http_path(c("t")).alias("path"), scalars.http_host(c("t")).alias("host"))


@query("b11_redis_fields", "SELECT event_id, CASE k % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'CLIENT LIST' ELSE NULL END AS command, CASE k % 3 WHEN 0 THEN 'key' || k WHEN 1 THEN '' ELSE 'ERR no' END AS payload, k % 3 = 2 AS failed FROM events_v", (EVENTS,))
def b11(spark, sf):
    k = c("k").cast("string")
    get = F.concat(F.lit("*2\r\n$3\r\nget\r\n$"), (F.length(k) + 3).cast("string"), F.lit("\r\nkey"), k, F.lit("\r\n"))
    text = F.when(c("k") % 3 == 0, get).when(c("k") % 3 == 1, F.lit("*2\r\n$6\r\nCLIENT\r\n$4\r\nlist\r\n")).otherwise(F.lit("-ERR no\r\n"))
    return adapters.events(spark, sf).select("event_id", scalars.redis_fields(text).alias("r")).select("event_id", "r.command", "r.payload", "r.failed")


@_records("b12_redis_key", "record_id, split_part(redis_payload, ' ', 1) AS key", "WHERE protocol = 8")
def b12(spark, sf):
    return adapters.records(spark, sf).where("protocol = 8").select("record_id", scalars.redis_key(c("redis.payload")).alias("key"))


@query("b13_protocol_tag", "SELECT event_id, CASE k % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 4 WHEN 4 THEN 7 ELSE NULL END AS protocol, CASE k % 6 WHEN 0 THEN 'req' WHEN 1 THEN 'resp' WHEN 2 THEN 'any' WHEN 3 THEN 'req' WHEN 4 THEN 'req' ELSE NULL END AS message FROM events_v", (EVENTS,))
def b13(spark, sf):
    """Payloads made of each event: HTTP both ways, RESP, a MySQL query, a DNS question, and text that is none of them."""
    k = c("k") % 6
    raw = (F.when(k == 0, F.encode(F.concat(F.lit("GET /p"), c("k").cast("string"), F.lit(" HTTP/1.1\r\n\r\n")), "UTF-8")).when(k == 1, F.encode(F.lit("HTTP/1.1 200 OK\r\n\r\n"), "UTF-8")).when(k == 2, F.encode(F.concat(F.lit(":"), c("k").cast("string"), F.lit("\r\n")), "UTF-8"))
           .when(k == 3, F.unhex(F.lit("090000000353454C4543542031"))).when(k == 4, F.unhex(F.lit("1A2B0100000100000000000003777777"))).otherwise(F.encode(F.lit("plain text of nobody"), "UTF-8")))
    return adapters.events(spark, sf).select("event_id", scalars.protocol_tag(raw).alias("t")).select("event_id", "t.protocol", "t.message")


@_records("b14_partial", "record_id, record_id % 9 = 0 OR resp_size > 9000 AS partial")
def b14(spark, sf):
    body = F.when(c("record_id") % 9 == 0, F.concat(c("response"), F.lit(scalars.UNCAPTURED + "0100"))).otherwise(c("response"))
    return adapters.records(spark, sf).select("record_id", scalars.is_partial(body, c("resp_size"), F.lit(9000)).alias("partial"))


@query("b15_b16_roles_and_times", "SELECT seq, conn_id, (CASE WHEN k % 2 = 0 THEN is_req ELSE NOT is_req END) AS request, ts_ns + CASE WHEN (k % 2 = 0) = (CASE WHEN k % 2 = 0 THEN is_req ELSE NOT is_req END) THEN 0 ELSE byte_size END AS at_ns FROM messages", (MESSAGES,))
def b15(spark, sf):
    side = F.when(c("k") % 2 == 0, "client").otherwise("server")
    rows = adapters.messages(spark, sf).withColumn("request", scalars.is_request(side, c("is_req")))
    return rows.select("seq", "conn_id", "request", scalars.message_time(c("ts_ns"), c("byte_size"), side, c("request")).alias("at_ns"))


@_records("b17_status", "record_id, CASE protocol WHEN 2 THEN CASE WHEN 200 + resp_size % 400 >= 400 THEN 2 ELSE 1 END WHEN 8 THEN CASE WHEN record_id % 17 = 0 THEN 2 ELSE 1 END WHEN 4 THEN CASE WHEN record_id % 3 = 0 THEN 3 ELSE record_id % 3 END ELSE 1 END AS status")
def b17(spark, sf):
    mysql = F.when(c("record_id") % 3 != 0, (c("record_id") % 3).cast("int"))
    return adapters.records(spark, sf).select("record_id", scalars.response_status(c("protocol"), c("record_id") % 17 == 0, mysql, 200 + c("resp_size") % 400).cast("long").alias("status"))


@query("b18_containers", "SELECT id, substr(name, 2) AS name, sandbox, pid_ns = 0 AND mnt_ns = 0 AND net_ns = 0 AS bare FROM containers", (CONTAINERS,))
def b18(spark, sf):
    rows = readers.parsed_labels(adapters.containers(spark, sf))
    return rows.select("id", scalars.container_name(c("name")).alias("name"), scalars.is_sandbox(c("labels")).alias("sandbox"), scalars.without_namespace(c("pid_ns"), c("mnt_ns"), c("net_ns")).alias("bare"))


_LANGUAGES = "[" + ", ".join(f"'{x}'" for x in names.ROCKETMQ_LANGUAGES) + "]"


@_records("b19_rocketmq_languages", f"record_id, {_LANGUAGES}[language + 1] AS name, language AS code", "WHERE language IS NOT NULL")
def b19(spark, sf):
    rows = adapters.records(spark, sf).where("rocketmq is not null").select("record_id", names.rocketmq_language(c("rocketmq.language")).alias("name"))
    return rows.withColumn("code", names.rocketmq_language_code(c("name")).cast("long"))


@_records("b20_kafka_keys", "record_id, CASE api_key WHEN 0 THEN 'Produce' WHEN 1 THEN 'Fetch' ELSE 'ListOffsets' END AS name, CASE WHEN api_key = 0 THEN resp_size % 20 >= 1 ELSE true END AND resp_size % 20 <= 17 AS supported, resp_size % 20 >= CASE api_key WHEN 0 THEN 9 WHEN 1 THEN 12 ELSE 6 END AS flexible", "WHERE api_key IS NOT NULL")
def b20(spark, sf):
    key, version = c("kafka.api_key"), c("resp_size") % 20
    return adapters.records(spark, sf).where("kafka is not null").select("record_id", names.kafka_key_name(key).alias("name"), names.kafka_supported(key, version).alias("supported"), names.kafka_flexible(key, version).alias("flexible"))


#: Least and first flexible version of every Kafka request, as a table of values: name:least:flexible, with nothing where there is none.
_KAFKA = ("Produce:1:9 Fetch:0:12 ListOffsets:0:6 Metadata:0:9 LeaderAndIsr:0:4 StopReplica:0:2 UpdateMetadata:0:6 ControlledShutdown:0:3 OffsetCommit:0:8 OffsetFetch:0:6 FindCoordinator:0:3 JoinGroup:0:6 Heartbeat:0:4 LeaveGroup:0:4 SyncGroup:0:4 "
          "DescribeGroups:0:5 ListGroups:0:3 SaslHandshake:0: ApiVersions:0:3 CreateTopics:0:5 DeleteTopics:0:4 DeleteRecords:0:2 InitProducerId:0:2 OffsetForLeaderEpoch:0:4 AddPartitionsToTxn:0:3 AddOffsetsToTxn:0:3 EndTxn:0:3 WriteTxnMarkers:0:1 "
          "TxnOffsetCommit:0:3 DescribeAcls:0:2 CreateAcls:0:2 DeleteAcls:0:2 DescribeConfigs:0:4 AlterConfigs:0:2 AlterReplicaLogDirs:0:2 DescribeLogDirs:0:2 SaslAuthenticate:0:2 CreatePartitions:0:2 CreateDelegationToken:0:2 ReneDelegationToken:0:2 "
          "ExpireDelegationToken:0:2 DescribeDelegationToken:0:2 DeleteGroups:0:5 ElectLeaders:0:2 IncrementalAlterConfigs:0:1 AlterPartitionReassignments:0:0 ListPartitionReassignments:0:0 OffsetDelete:0: DescribeClientQuotas:0:1 AlterClientQuotas:0:1 "
          "DescribeUserScramCredentials:0:0 AlterUserScramCredentials:0:0 - - - - AlterIsr:0:0 UpdateFeatures:0:0 - - DescribeCluster:0:0 DescribeProducers:0:0").split()
_KAFKA_ROWS = ", ".join(f"({k}, '{n}', {least}, {first or 'NULL'})" for k, x in enumerate(_KAFKA) if x != "-" for n, least, first in [x.split(":")])


@query("b20_all_kafka_keys", f"SELECT key, version, count(*) AS records, coalesce(any_value(name), 'Unknown') AS name, coalesce(version >= any_value(least) AND version <= 17, false) AS supported, coalesce(version >= any_value(flex), false) AS flexible FROM (SELECT record_id % 67 - 2 AS key, record_id // 67 % 20 - 1 AS version FROM records) LEFT JOIN (VALUES {_KAFKA_ROWS}) t(k, name, least, flex) ON k = key GROUP BY key, version", (RECORDS,))
def b20_all(spark, sf):
    """Every key, some that are none, and every version."""
    r = adapters.records(spark, sf).select(((c("record_id") % 67) - 2).alias("key"), (F.floor(c("record_id") / 67) % 20 - 1).cast("long").alias("version"))
    key, version = c("key").cast("int"), c("version")
    return r.groupBy("key", "version").agg(F.count(F.lit(1)).alias("records")).withColumns({"name": names.kafka_key_name(key), "supported": names.kafka_supported(key, version), "flexible": names.kafka_flexible(key, version)})


@query("b22_process_label", "SELECT record_id, r.pid || '<' || coalesce(p.name, '') || '>' AS process FROM records r LEFT JOIN processes p ON r.pid = p.pid", (RECORDS, PROCESSES))
def b22(spark, sf):
    rows = adapters.records(spark, sf).join(adapters.processes(spark, sf).select("pid", "name"), "pid", "left")
    return rows.select("record_id", scalars.process_label(c("pid"), c("name")).alias("process"))


_STEPS = "[" + ", ".join(f"'{x}'" for x in names.STEPS) + "]"


@query("b23_steps", f"SELECT step, {_STEPS}[step + 1] AS name, CASE WHEN step <= 7 THEN 'egress' ELSE 'ingress' END AS direction, count(*) AS n FROM kern GROUP BY ALL", (KERN,))
def b23(spark, sf):
    return adapters.kern_events(spark, sf).groupBy("step", names.step_name(c("step")).alias("name"), names.direction(c("step")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@_records("b24_summaries", "record_id, CASE protocol WHEN 2 THEN '[HTTP] ' || http_method || ' http://' || http_host || http_path WHEN 8 THEN '[Redis] ' || redis_command || ' ' || redis_payload ELSE request END AS summary")
def b24(spark, sf):
    return adapters.records(spark, sf).select("record_id", scalars.request_summary(c("protocol"), c("http.method"), c("http.host"), c("http.path"), c("redis.command"), c("redis.payload"), c("request")).alias("summary"))


@_records("b24_message_texts", """record_id, CASE protocol WHEN 4 THEN 'base=[r' || record_id || '] status=[' || response_status || '] Msg=[' || response || ']' WHEN 11 THEN '[FrameBase: r' || record_id || '] Apikey: ' || CASE api_key WHEN 0 THEN 'Produce' WHEN 1 THEN 'Fetch' ELSE 'ListOffsets' END || ', ApiVersion: ' || (k % 4) || ', ClientId: c' || (k % 3) || ', Msg: ' || request
 WHEN 7 THEN 'DNS Frame: TXID=' || txid || ', Flags=' || (k % 2) || ', NumQueries=2, NumAnswers=0, NumAuth=0, NumAddl=0, Records=[
  {
    "name": "' || dns_names[1] || '",
    "cname": "",
    "type": 1
  },
  {
    "name": "' || dns_names[2] || '",
    "cname": "",
    "type": 1
  }
]'
 WHEN 8 THEN 'MongoDB base=[r' || record_id || ']  Msg=[' || request || ']' ELSE 'base=[r' || record_id || '] detail=[code=10, language=' || (k % 14) || ', version=1, opaque=' || k || ', flag=0, remark=ok, extFields=' || CASE WHEN k % 2 = 0 THEN '{a=' || k || ', b=x}' ELSE '' END || ', body=' || response || ']' END AS text""")
def b24_texts(spark, sf):
    """The texts of five protocols; Redis records stand in for MongoDB, HTTP for RocketMQ."""
    rows, base, number = adapters.records(spark, sf), F.concat(F.lit("r"), c("record_id").cast("string")), lambda x: F.lit(x).cast("string")
    k = c("k") if "k" in rows.columns else (c("req_size") - 64)
    api = F.element_at(F.array(*map(F.lit, ("Produce", "Fetch", "ListOffsets"))), c("kafka.api_key") + 1)
    properties = F.when(k % 2 == 0, F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), k.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    asked = F.transform("dns.names", lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("cname"), F.lit(1).alias("type")))
    text = (F.when(c("protocol") == 4, scalars.mysql_text(base, c("response_status"), c("response")))
            .when(c("protocol") == 11, scalars.kafka_text(base, api, k % 4, F.concat(F.lit("c"), (k % 3).cast("string")), c("request")))
            .when(c("protocol") == 7, scalars.dns_text(c("dns.txid"), k % 2, F.lit(2), F.lit(0), F.lit(0), F.lit(0), asked))
            .when(c("protocol") == 8, scalars.mongo_text(base, c("request")))
            .otherwise(scalars.rocketmq_text(base, number(10), k % 14, number(1), k, number(0), number("ok"), properties, c("response"))))
    return rows.select("record_id", text.alias("text"))


def _kafka_bodies(spark, sf):
    """Records of Kafka with bodies made of their topics: partition i of a topic has i + 1 records."""
    one = lambda i: F.struct(F.lit(i).alias("index"), (c("record_id") % 3).cast("smallint").alias("error_code"), (c("record_id") * 10 + i).alias("high_watermark"), F.lit(0).cast("long").alias("last_stable_offset"), c("record_id").cast("long").alias("log_start_offset"), F.lit(-1).alias("preferred_read_replica"),
                             F.struct(F.lit(100 * (i + 1)).cast("long").alias("size"), F.array(F.struct(F.array(*[F.struct(F.concat(F.lit(f"k{j}-"), c("record_id").cast("string")).alias("key"), c("response").alias("value")) for j in range(i + 1)]).alias("records"))).alias("record_batches")).alias("message_set"))
    topics = F.transform("kafka.resp_topics", lambda t: F.struct(t.alias("name"), F.array(one(0), one(1)).alias("partitions")))
    body = F.struct(F.lit(0).alias("throttle_time_ms"), F.lit(0).cast("smallint").alias("error_code"), F.lit(1).alias("session_id"), topics.alias("topics"))
    return adapters.records(spark, sf).where("protocol = 11").select("record_id", body.cast(bodies.FETCH_RESPONSE).alias("body"))


@query("b25_kafka_partitions", 'SELECT record_id, topic, i AS "index", CAST(record_id % 3 AS SMALLINT) AS error_code, record_id * 10 + i AS high_watermark, record_id AS log_start_offset, CAST(100 * (i + 1) AS BIGINT) AS size FROM (SELECT record_id, unnest(resp_topics) AS topic FROM records WHERE protocol = 11), (SELECT unnest([0, 1]) AS i)', (RECORDS,))
def b25_partitions(spark, sf):
    return bodies.partitions(_kafka_bodies(spark, sf)).select("record_id", "topic", "index", "error_code", "high_watermark", "log_start_offset", c("message_set.size").alias("size"))


@query("b25_kafka_records", """SELECT record_id, topic, i AS "index", 0 AS batch, j AS place, 'k' || j || '-' || record_id AS key, response AS value FROM (SELECT record_id, response, unnest(resp_topics) AS topic FROM records WHERE protocol = 11), (SELECT unnest([0, 1, 1]) AS i, unnest([0, 0, 1]) AS j)""", (RECORDS,))
def b25_records(spark, sf):
    return bodies.records(_kafka_bodies(spark, sf))


@query("b25_produce_responses", """SELECT record_id, topic, 7 AS "index", CAST(record_id % 2 AS SMALLINT) AS error_code, record_id * 3 AS base_offset, 'e' || record_id AS error_message FROM (SELECT record_id, unnest(req_topics) AS topic FROM records WHERE protocol = 11)""", (RECORDS,))
def b25_produce(spark, sf):
    part = F.struct(F.lit(7).alias("index"), (c("record_id") % 2).cast("smallint").alias("error_code"), (c("record_id") * 3).alias("base_offset"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast("array<struct<batch_index:int,error_message:string>>").alias("record_errors"), F.concat(F.lit("e"), c("record_id").cast("string")).alias("error_message"))
    body = F.struct(F.transform("kafka.req_topics", lambda t: F.struct(t.alias("name"), F.array(part).alias("partitions"))).alias("topics"), F.lit(0).alias("throttle_time_ms"))
    rows = adapters.records(spark, sf).where("protocol = 11").select("record_id", body.cast(bodies.PRODUCE_RESPONSE).alias("body"))
    return bodies.partitions(rows).select("record_id", "topic", "index", "error_code", "base_offset", "error_message")


@query("b25_produce_requests", """SELECT record_id, topic, i AS "index", 0 AS batch, j AS place, 'k' || j AS key, request AS value FROM (SELECT record_id, request, unnest(req_topics) AS topic FROM records WHERE protocol = 11), (SELECT unnest([3, 4, 4]) AS i, unnest([0, 0, 1]) AS j)""", (RECORDS,))
def b25_produce_requests(spark, sf):
    """The records that are produced, by topic and partition: one in the first partition, two in the second."""
    record = lambda j: F.struct(F.lit(f"k{j}").alias("key"), c("request").alias("value"))
    part = lambda i, n: F.struct(F.lit(i).alias("index"), F.struct(F.lit(10 * n).alias("size"), F.array(F.struct(F.array(*map(record, range(n))).alias("records"))).alias("record_batches")).alias("message_set"))
    body = F.struct(F.lit(None).cast("string").alias("transactional_id"), F.lit(1).cast("smallint").alias("acks"), F.lit(30).alias("timeout_ms"), F.transform("kafka.req_topics", lambda t: F.struct(t.alias("name"), F.array(part(3, 1), part(4, 2)).alias("partitions"))).alias("topics"))
    return bodies.records(adapters.records(spark, sf).where("protocol = 11").select("record_id", body.cast(bodies.PRODUCE_REQUEST).alias("body")))


@_records("b25_kafka_topics", "record_id, unnest(req_topics) AS topic, unnest([0, 1]) AS place", "WHERE api_key = 0")
def b25(spark, sf):
    rows = adapters.records(spark, sf).where("kafka.api_key = 0")
    return rows.select("record_id", F.posexplode("kafka.req_topics").alias("place", "topic"))


@query("b26_dns_records", """SELECT record_id, place, name, type, CASE type WHEN 1 THEN 'A' WHEN 28 THEN 'AAAA' ELSE 'UNKNOWN' END AS type_name, cname FROM (SELECT record_id, i AS place, dns_names[i + 1] AS name, CAST(1 AS INTEGER) AS type, NULL AS cname FROM records, (SELECT unnest([0, 1]) AS i) WHERE protocol = 7
 UNION ALL SELECT record_id, 2 + i, dns_names[i + 1], CASE txid % 3 WHEN 0 THEN 1 WHEN 1 THEN 28 ELSE 5 END, CASE WHEN txid % 3 < 2 THEN remote_addr ELSE dns_names[i + 1] || ' CNAME' END FROM records, (SELECT unnest([0, 1]) AS i) WHERE protocol = 7)""", (RECORDS,))
def b26(spark, sf):
    kind = F.when(c("dns.txid") % 3 == 0, 1).when(c("dns.txid") % 3 == 1, 28).otherwise(5)
    asked = F.transform("dns.names", lambda x: F.struct(x.alias("name"), F.lit(1).alias("type")))
    told = F.transform("dns.names", lambda x: F.struct(x.alias("name"), kind.alias("type"), c("remote_addr").alias("value"), F.concat(x, F.lit(" CNAME")).alias("text")))
    return bodies.dns_records(adapters.records(spark, sf).where("protocol = 7").select("record_id", asked.alias("questions"), told.alias("answers")))


# --- filters ---------------------------------------------------------------------------------------------------------------
def _filter(name: str, where: str, **options):
    @_records(name, "record_id, remote_addr, total_ns", f"WHERE {where}")
    def run(spark, sf):
        return RecordFilter(**options).apply(adapters.records(spark, sf)).select("record_id", "remote_addr", "total_ns")

    return run


_filter("c1_pid", "pid IN (1001, 1007)", pids=[1001, 1007])
_filter("c3_local_port", "local_port IN (30003, 30008, 30046)", local_ports=[30003, 30008, 30046])
_filter("c4_remote_port", "remote_port IN (8002)", remote_ports=[8002])
_filter("c5_remote_ip", "remote_addr IN ('192.168.0.9', '192.168.6.9')", remote_ips=["192.168.0.9", "192.168.6.9"])
_filter("c6_side", "side = 'client'", side="client")
_filter("c7_protocol", "protocol = 2", protocol=2)
_filter("c7_known_protocol", "protocol > 1", known_protocol=True)
_filter("c8_latency", "end_ns - start_ns >= 150000000", min_latency_ms=150)
_filter("c9_c10_sizes", "req_size >= 120 AND resp_size >= 5000", min_req_size=120, min_resp_size=5000)
_filter("c11_http_path", "http_path = '/p3/i1'", http_path="/p3/i1")
_filter("c12_http_path_prefix", "http_path LIKE '/p3%'", http_path_prefix="/p3")
_filter("c13_http_path_regex", "regexp_matches(http_path, 'p[1-4]/i(0|2)')", http_path_regex="p[1-4]/i(0|2)")
_filter("c14_http_method", "http_method IN ('GET', 'HEAD')", http_methods=["GET", "HEAD"])
_filter("c15_http_host", "http_host = 'h2.example.com'", http_host="h2.example.com")
_filter("c16_redis_command", "redis_command IN ('GET', 'CLIENT LIST')", redis_commands=["get", "client list"])
_filter("c17_redis_key", "split_part(redis_payload, ' ', 1) IN ('key3', 'key7')", redis_keys=["key3", "key7"])
_filter("c18_redis_key_prefix", "redis_payload LIKE 'key1%'", redis_key_prefix="key1")
_filter("c19_kafka_api_key", "api_key IN (0, 2)", kafka_api_keys=[0, 2])
_filter("c20_kafka_topic", "(api_key = 0 AND list_contains(req_topics, 't2')) OR (api_key = 1 AND list_contains(resp_topics, 't2'))", kafka_topic="t2")
_filter("c21_c22_rocketmq", "request_code IN (10, 11) AND language IN (0, 9)", rocketmq_codes=[10, 11], rocketmq_languages=[0, 9])
_filter("c23_dns_host", "protocol = 7 AND (dns_names[1] LIKE 'alias.h3%' OR dns_names[2] LIKE 'alias.h3%')", dns_host="alias.h3")


@query("c2_process_name", "SELECT record_id, pid FROM records WHERE pid IN (SELECT pid FROM processes WHERE name = 'red-widget' OR contains(name, '/red-widget'))", (RECORDS, PROCESSES))
def c2(spark, sf):
    return filters.by_process_name(adapters.records(spark, sf), adapters.processes(spark, sf), "red-widget").select("record_id", "pid")


_CONTAINER_PIDS = "(SELECT root_pid FROM containers WHERE {})"


@query("c24_container_id", f"SELECT record_id FROM records WHERE pid IN {_CONTAINER_PIDS.format('id LIKE left(md5(' + chr(39) + 'c7' + chr(39) + '), 12) || ' + chr(39) + '%' + chr(39))}", (RECORDS, CONTAINERS))
def c24(spark, sf):
    import hashlib

    found = enrich.choose_containers(readers.parsed_labels(adapters.containers(spark, sf)), container_id=hashlib.md5(b"c7").hexdigest()[:12])
    return adapters.records(spark, sf).join(found.select(c("root_pid").alias("pid")), "pid", "left_semi").select("record_id")


@query("c25_container_name", f"SELECT record_id FROM records WHERE pid IN {_CONTAINER_PIDS.format('name = ' + chr(39) + '/customer#000000003' + chr(39))}", (RECORDS, CONTAINERS))
def c25(spark, sf):
    found = enrich.choose_containers(readers.parsed_labels(adapters.containers(spark, sf)), name="customer#000000003")
    return adapters.records(spark, sf).join(found.select(c("root_pid").alias("pid")), "pid", "left_semi").select("record_id")


@query("c26_pod", "SELECT id, pod FROM containers WHERE pod = 'pod-7' AND namespace = 'building'", (CONTAINERS,))
def c26(spark, sf):
    return enrich.choose_containers(readers.parsed_labels(adapters.containers(spark, sf)), pod="pod-7.building").select("id", "pod")


@query("c27_usable_containers", "SELECT id, net_ns FROM containers WHERE NOT sandbox AND NOT (pid_ns = 0 AND mnt_ns = 0 AND net_ns = 0) AND net_ns <> 4026533005", (CONTAINERS,))
def c27(spark, sf):
    return enrich.usable_containers(readers.parsed_labels(adapters.containers(spark, sf)), 4026533005).select("id", "net_ns")


# --- statistics ------------------------------------------------------------------------------------------------------------
_BUCKETS = ", ".join(f"count(*) FILTER (v {'' if i == 0 else '> ' + str(1 << i - 1) + ' AND v '}<= {1 << i}) AS h{i}" for i in range(13)) + ", count(*) FILTER (v > 4096) AS h13"
_N = " + ".join(f"h{i}" for i in range(14))


def _percentile(p: int) -> str:
    rank, parts, cum = f"(({_N}) * {p} + 99) // 100", [], []
    for i in range(13):
        cum.append(f"h{i}")
        low, high = (1 << i - 1) if i else 0, 1 << i
        parts.append(f"WHEN {' + '.join(cum)} >= {rank} THEN (1.0::DOUBLE - ({' + '.join(cum)} - {rank})::DOUBLE / h{i}) * {float(high - low)}::DOUBLE + {float(low)}::DOUBLE")
    return f"CASE WHEN {_N} = 0 THEN 0.0::DOUBLE {' '.join(parts)} ELSE 8192.0::DOUBLE END AS p{p}"


_KEYS = {"none": "'none'", "conn": "conn_id", "remote-port": "CAST(remote_port AS VARCHAR)", "local-port": "CAST(local_port AS VARCHAR)", "remote-ip": "remote_addr", "protocol": "CAST(protocol AS VARCHAR)",
         "http-path": "CASE WHEN protocol = 2 THEN http_path ELSE '_not_a_http_req_' END", "redis-command": "CASE WHEN protocol = 8 THEN redis_command ELSE '_not_a_redis_req_' END", "protocol-adaptive": "CASE protocol WHEN 2 THEN http_path WHEN 8 THEN redis_command ELSE remote_addr END"}
_VALUES = {"total-time": "total_ns", "reqsize": "req_size", "respsize": "resp_size", "network-time": "black_box_ns", "internal-time": "black_box_ns", "socket-time": "read_socket_ns"}
_SIDES = {"network-time": "WHERE side = 'client'", "internal-time": "WHERE side = 'server'"}


def _stat_sql(key: str, metric: str, where: str = "", sub: str | None = None) -> str:
    size = metric in stats.SIZES
    v = f"CAST({_VALUES[metric]} AS DOUBLE)" + ("" if size else " / 1e6")
    total = ", CAST(s AS DOUBLE) AS total" if size else ""
    avg = "CAST(s AS DOUBLE) / nv" if size else "round(CAST(s AS DOUBLE) / nv / 1e6, 6)"
    out = f"count, failed_count, max, {avg} AS avg, {_percentile(50)}, {_percentile(90)}, {_percentile(99)}{total}"
    aggs = f"count(*) AS count, count(*) FILTER (response_status <> 1) AS failed_count, max(v) AS max, sum(CAST({_VALUES[metric]} AS BIGINT)) AS s, count(v) AS nv, {_BUCKETS}"
    if sub is None:
        return f", x AS (SELECT *, {v} AS v, {_KEYS[key]} AS class_id FROM records {where or _SIDES.get(metric, '')}), g AS (SELECT class_id, {aggs} FROM x GROUP BY class_id) SELECT class_id, {out} FROM g"
    return (f", x AS (SELECT *, {v} AS v, {_KEYS[key]} AS class_id, {_KEYS[sub]} AS sub_id FROM records {where or _SIDES.get(metric, '')}), g AS (SELECT class_id, sub_id, grouping(sub_id) AS whole, arg_min(protocol, struct_pack(a := v, b := start_ns, c := record_id)) AS protocol, {aggs} FROM x GROUP BY GROUPING SETS ((class_id), (class_id, sub_id))) "
            f"SELECT CASE WHEN whole = 0 THEN class_id || '||' || sub_id ELSE class_id END AS class_id, whole = 0 AS is_sub, {{}}{out} FROM g")


def _rounded(table, metric: str):
    """Averages of times to six places: a sum of doubles depends on its order."""
    return table if metric in stats.SIZES else table.withColumn("avg", F.round("avg", 6))


def _stat(name: str, key: str, metric: str):
    @query(name, "SELECT * FROM (WITH " + _stat_sql(key, metric).removeprefix(", ") + ")", (RECORDS,))
    def run(spark, sf):
        return _rounded(stats.stat(adapters.records(spark, sf), key, metric), metric)

    return run


for _key in _KEYS:
    _stat(f"e1_{_key.replace('-', '_')}", _key, "total-time")
for _metric in ("reqsize", "respsize", "network-time", "internal-time", "socket-time"):
    _stat(f"e2_{_metric.replace('-', '_')}", "remote-ip", _metric)


@query("stat_remote_ip_slow", "SELECT * FROM (WITH " + _stat_sql("remote-ip", "total-time", "WHERE protocol = 2 AND end_ns - start_ns >= 10000000").removeprefix(", ") + ")", (RECORDS,))
def stat_remote_ip_slow(spark, sf):
    return _rounded(StatQuery(RecordFilter(protocol=names.HTTP, min_latency_ms=10), slow=True, sort_by="max", descending=True).run(adapters.records(spark, sf)), "total-time")


@query("e3_exact_percentiles", "SELECT remote_addr AS class_id, quantile_cont(total_ns / 1e6, 0.5) AS p50, quantile_cont(total_ns / 1e6, 0.9) AS p90 FROM records GROUP BY remote_addr", (RECORDS,))
def e3_exact(spark, sf):
    return stats.stat(adapters.records(spark, sf), "remote-ip", "total-time", exact=True).select("class_id", "p50", "p90")


#: Shares of a class's values that a sketch's percentile may be off by.
_OFF = 0.03


@query("e3_approximate", "SELECT remote_addr AS class_id, count(*) AS count, max(total_ns) / 1e6 AS max, true AS p50_near, true AS p90_near, true AS p99_near FROM records GROUP BY remote_addr", (RECORDS,))
def e3_approx(spark, sf):
    """Percentiles of sketches, and whether the values up to each of them are the share that they should be."""
    r = adapters.records(spark, sf)
    told = stats.stat(r, "remote-ip", "total-time", approx=True).select("class_id", "count", "max", "p50", "p90", "p99")
    up_to = r.select(c("remote_addr").alias("class_id"), (c("total_ns") / 1e6).alias("v")).join(told, "class_id").groupBy("class_id").agg(F.min("count").alias("count"), F.min("max").alias("max"), *(F.struct(F.count_if(c("v") < c(p)), F.count_if(c("v") <= c(p))).alias(p) for p in ("p50", "p90", "p99")))
    near = lambda p: (c(p)["col1"] <= (int(p[1:]) / 100 + _OFF) * c("count")) & (c(p)["col2"] >= (int(p[1:]) / 100 - _OFF) * c("count"))
    return up_to.select("class_id", "count", "max", *(near(p).alias(f"{p}_near") for p in ("p50", "p90", "p99")))


_DAILY = "SELECT * FROM (WITH " + _stat_sql("remote-ip", "respsize").removeprefix(", ").replace("x AS (SELECT *,", "x AS (SELECT *, start_ns // 86400000000000 AS day,").replace("g AS (SELECT class_id,", "g AS (SELECT class_id, day,").replace("GROUP BY class_id)", "GROUP BY class_id, day)").replace(") SELECT class_id,", ") SELECT class_id, day,") + ")"


@query("e3_j3_daily_states", _DAILY, (RECORDS,))
def e3_states(spark, sf):
    """States of hours, merged to days."""
    hours = rollups.states(adapters.records(spark, sf), "remote-ip", "respsize", 3600)
    days = rollups.merged(hours.withColumn("day", F.expr("window_us div 86400000000")), "class_id", "day")
    return rollups.measured(days, total=True)


@query("j3_sql_rollup", _DAILY, (RECORDS,))
def j3_sql(spark, sf):
    """The same as SQL texts: counters of hours, stored as arrays, then days from those."""
    hours = sql.register(spark).sql("""
        SELECT class_id, hour, sum(n) AS count, sum(failed) AS failed_count, max(top) AS max, sum(s) AS total, netlens_counters(collect_list(struct(bucket, n))) AS h
        FROM (SELECT remote_addr AS class_id, start_ns div 3600000000000 AS hour, netlens_bucket(CAST(resp_size AS DOUBLE)) AS bucket, count(*) AS n, count_if(response_status <> 1) AS failed, max(CAST(resp_size AS DOUBLE)) AS top, sum(CAST(resp_size AS DOUBLE)) AS s
              FROM {records} GROUP BY ALL) GROUP BY class_id, hour""", records=adapters.records(spark, sf))
    return spark.sql("""
        WITH days AS (SELECT class_id, hour div 24 AS day, sum(count) AS count, sum(failed_count) AS failed_count, max(max) AS max, sum(total) AS total FROM {hours} GROUP BY ALL),
        parts AS (SELECT class_id, hour div 24 AS day, bucket, sum(n) AS n FROM {hours} LATERAL VIEW posexplode(h) x AS bucket, n GROUP BY ALL),
        states AS (SELECT class_id, day, netlens_counters(collect_list(struct(bucket, n))) AS h FROM parts GROUP BY ALL)
        SELECT class_id, day, count, failed_count, max, total / count AS avg, netlens_percentile(h, 50) AS p50, netlens_percentile(h, 90) AS p90, netlens_percentile(h, 99) AS p99, total FROM days JOIN states USING (class_id, day)""", hours=hours)


@query("e4_top_samples", "SELECT record_id, remote_addr AS class_id, total_ns / 1e6 AS value, CAST(row_number() OVER (PARTITION BY remote_addr ORDER BY total_ns DESC, start_ns, record_id) AS INTEGER) AS rank FROM records QUALIFY rank <= 5", (RECORDS,))
def e4(spark, sf):
    return stats.top_samples(adapters.records(spark, sf), "remote-ip", "total-time", 5).select("record_id", "class_id", "value", "rank")


@query("e5_two_level", "SELECT * FROM (WITH " + _stat_sql("remote-ip", "respsize", sub="protocol").removeprefix(", ").format("class_id AS parent_id, ") + ")", (RECORDS,))
def e5(spark, sf):
    return stats.stat_two_level(adapters.records(spark, sf), "remote-ip", "protocol", "respsize")


_PROTOCOL = "CASE protocol WHEN 2 THEN 'HTTP' WHEN 8 THEN 'Redis' WHEN 4 THEN 'MySQL' WHEN 11 THEN 'Kafka' ELSE '' END AS protocol, "


@query("e6_overview", "SELECT * FROM (WITH " + _stat_sql("remote-ip", "total-time", sub="protocol-adaptive").removeprefix(", ").format(_PROTOCOL) + ")", (RECORDS,))
def e6(spark, sf):
    return _rounded(stats.overview(adapters.records(spark, sf)), "total-time")


def _preset(name: str, metric: str, **options):
    @query(name, "SELECT * FROM (WITH " + _stat_sql("remote-ip", metric).removeprefix(", ") + ")", (RECORDS,))
    def run(spark, sf):
        return _rounded(StatQuery(**options).run(adapters.records(spark, sf)), metric)


_preset("e7_bigreq", "reqsize", big_req=True)
_preset("e7_bigresp", "respsize", big_resp=True, big_req=True)


@query("e8_labels", "SELECT conn_id AS class_id, arg_min(local_addr || ':' || local_port || CASE side WHEN 'client' THEN ' => ' ELSE ' <= ' END || remote_addr || ':' || remote_port, struct_pack(a := start_ns, b := record_id)) AS label FROM records GROUP BY conn_id", (RECORDS,))
def e8(spark, sf):
    return stats.class_labels(adapters.records(spark, sf), "conn")


# --- lists -----------------------------------------------------------------------------------------------------------------
_CLOCK = "strftime(make_timestamp(start_ns // 1000000000 * 1000000), '%H:%M:%S') || '.' || lpad(CAST(start_ns % 1000000000 // 1000000 AS VARCHAR), 3, '0') AS start_time"


@_records("g2_watch", f"record_id, {_CLOCK}, pid, local_addr || ':' || local_port || CASE side WHEN 'client' THEN ' => ' ELSE ' <= ' END || remote_addr || ':' || remote_port AS connection, {_PROTOCOL} printf('%.2f', total_ns / 1e6) AS total, req_size, resp_size, coalesce(printf('%.2f', black_box_ns / 1e6), '-') AS net_internal, coalesce(printf('%.2f', read_socket_ns / 1e6), '-') AS read_socket")
def g2(spark, sf):
    return watch.watch(adapters.records(spark, sf), "total-time", descending=True, wide=True)


@_records("g3_most_recent", "record_id, start_ns", "ORDER BY start_ns DESC, record_id DESC LIMIT 100")
def g3(spark, sf):
    return watch.most_recent(adapters.records(spark, sf)).select("record_id", "start_ns")


@query("g1_sorted_stat_top", "SELECT * FROM (WITH " + _stat_sql("conn", "respsize").removeprefix(", ") + ") ORDER BY count DESC, class_id LIMIT 20", (RECORDS,))
def g1(spark, sf):
    return StatQuery(metric="respsize", sort_by="count", descending=True, limit=20).run(adapters.records(spark, sf))


@query("g4_samples_view", "SELECT record_id, CAST(resp_size AS DOUBLE) AS value FROM records QUALIFY row_number() OVER (PARTITION BY CAST(protocol AS VARCHAR) ORDER BY resp_size DESC, start_ns, record_id) <= 10", (RECORDS,))
def g4(spark, sf):
    return stats.samples_view(stats.top_samples(adapters.records(spark, sf), "protocol", "respsize", 0)).select("record_id", "value")


@query("g5_f5_request_order", "SELECT record_id, CAST(row_number() OVER (ORDER BY start_ns, record_id) AS INTEGER) AS no FROM records", (RECORDS,))
def g5(spark, sf):
    return stats.numbered(adapters.records(spark, sf), "start_ns", "record_id").select("record_id", c("no").cast("int").alias("no"))


@_records("a2_json_fields", f"record_id, CASE protocol WHEN 2 THEN 'HTTP' WHEN 8 THEN 'Redis' WHEN 4 THEN 'MySQL' WHEN 11 THEN 'Kafka' ELSE '' END AS protocol, total_ns / 1e6 AS total_duration_ms, resp_size AS resp_size_bytes, response")
def a2(spark, sf):
    """Through the JSON text and back."""
    lines = readers.json_lines(adapters.records(spark, sf))
    got = lines.select(F.from_json("value", "protocol string, total_duration_ms double, resp_size_bytes long, response string").alias("j")).select("j.*")
    return got.withColumn("record_id", F.substring_index("response", " ", -1).cast("long"))


@_records("a6_text_blocks", "local_addr || ':' || local_port || CASE side WHEN 'client' THEN ' => ' ELSE ' <= ' END || remote_addr || ':' || remote_port || ' ' || CASE protocol WHEN 2 THEN 'HTTP' WHEN 8 THEN 'Redis' WHEN 4 THEN 'MySQL' WHEN 11 THEN 'Kafka' ELSE '' END || ' pid=' || pid || chr(10) || '[ Request ]' || chr(10) || request AS value")
def a6(spark, sf):
    return readers.format_records(adapters.records(spark, sf), response=False, timings=False)


@query("f4_stages", """SELECT record_id, CAST(place AS INTEGER) AS place, stage, ns FROM (
 SELECT record_id, 0 AS place, CASE side WHEN 'client' THEN 'process to network' ELSE 'network to socket' END AS stage, CASE side WHEN 'client' THEN total_ns - coalesce(black_box_ns, 0) - coalesce(read_socket_ns, 0) - coalesce(copy_to_sock_ns, 0) ELSE copy_to_sock_ns END AS ns FROM records
 UNION ALL SELECT record_id, 1, CASE side WHEN 'client' THEN 'network' ELSE 'socket to process' END, CASE side WHEN 'client' THEN black_box_ns ELSE read_socket_ns END FROM records
 UNION ALL SELECT record_id, 2, CASE side WHEN 'client' THEN 'network to socket' ELSE 'process' END, CASE side WHEN 'client' THEN copy_to_sock_ns ELSE black_box_ns END FROM records
 UNION ALL SELECT record_id, 3, CASE side WHEN 'client' THEN 'socket to process' ELSE 'process to network' END, CASE side WHEN 'client' THEN read_socket_ns ELSE total_ns - coalesce(black_box_ns, 0) - coalesce(read_socket_ns, 0) - coalesce(copy_to_sock_ns, 0) END FROM records) WHERE ns IS NOT NULL""", (RECORDS,))
def f4(spark, sf):
    return hops.stages(adapters.records(spark, sf))


@query("j3_histogram", f"SELECT remote_addr, {', '.join(f'h{i}' for i in (0, 5, 7, 8, 13))} FROM (SELECT remote_addr, {_BUCKETS} FROM (SELECT *, total_ns / 1e6 AS v FROM records) GROUP BY remote_addr)", (RECORDS,))
def j3(spark, sf):
    out = adapters.records(spark, sf).groupBy("remote_addr").agg(*histogram.counters(scalars.ns_to_ms(c("total_ns"))))
    return out.select("remote_addr", *[f"h{i}" for i in (0, 5, 7, 8, 13)])


@query("d16_nat", """, flows_0 AS (SELECT sip AS la, sport AS lp, dip AS ra, dport AS rp, to_dip AS ta, to_dport AS tp FROM nat UNION ALL SELECT to_dip, to_dport, to_sip, to_sport, sip, sport FROM nat), flows AS (SELECT la, lp, ra, rp, min(struct_pack(a := ta, p := tp)) AS t FROM flows_0 GROUP BY ALL)
 SELECT record_id, coalesce(t.a, remote_addr) AS real_remote_addr, CAST(coalesce(t.p, remote_port) AS INTEGER) AS real_remote_port FROM records LEFT JOIN flows ON la = local_addr AND lp = local_port AND ra = remote_addr AND rp = remote_port""".replace(", flows_0", "SELECT * FROM (WITH flows_0", 1) + ")", (RECORDS, NAT))
def d16(spark, sf):
    from netlens.operators import connections

    return connections.resolve_nat(adapters.records(spark, sf), adapters.nat_flows(spark, sf)).select("record_id", "real_remote_addr", "real_remote_port")
