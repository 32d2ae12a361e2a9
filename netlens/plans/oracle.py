"""The adapters' views as DuckDB SQL, for checking registered queries."""

EVENTS = """events_v AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) * 1000 AS ts_ns, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

RECORDS = EVENTS + """, records_0 AS (SELECT *, CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 8 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 11 ELSE 7 END AS protocol, CAST(round(value * 100) AS BIGINT) * 10000 AS total,
 '/p' || (k % 10) || '/i' || (k % 3) AS hpath, ['GET', 'POST', 'HEAD'][k % 3 + 1] AS hmethod, 'h' || (k % 6) || '.example.com' AS hhost,
 ['GET', 'SET', 'HGETALL', 'CLIENT LIST'][k % 4 + 1] AS rcommand, 'key' || (k % 13) || ' v' || (event_id % 5) AS rpayload FROM events_v),
records AS (SELECT event_id AS record_id, user_id, '10.0.0.' || (user_id % 16) AS local_addr, CAST(30000 + user_id AS INTEGER) AS local_port, '192.168.' || (user_id % 8) || '.' || (k % 10) AS remote_addr, CAST(8000 + protocol AS INTEGER) AS remote_port,
 '10.0.0.' || (user_id % 16) || '|' || (30000 + user_id) || '|192.168.' || (user_id % 8) || '.' || (k % 10) || '|' || (8000 + protocol) AS conn_id,
 1000 + user_id % 20 AS pid, protocol, CASE WHEN event_id % 2 = 0 THEN 'server' ELSE 'client' END AS side, event_id % 5 = 0 AS is_ssl, ts_ns AS start_ns, ts_ns + total AS end_ns, total AS total_ns,
 CASE WHEN event_id % 7 <> 0 THEN total // 10 * 6 END AS black_box_ns, CASE WHEN event_id % 11 <> 0 THEN total // 10 * 2 END AS read_socket_ns, CASE WHEN event_id % 13 <> 0 THEN total // 10 END AS copy_to_sock_ns,
 64 + k AS req_size, (k * 137 + event_id) % 9973 AS resp_size, CASE WHEN event_id % 5 = 0 THEN 44 + k END AS req_plain_size, CASE WHEN event_id % 5 = 0 THEN (k * 137 + event_id) % 9973 END AS resp_plain_size,
 CASE protocol WHEN 2 THEN hmethod || ' ' || hpath || ' ' || hhost WHEN 8 THEN rcommand || ' ' || rpayload ELSE 'req ' || k END AS request, 'resp ' || event_id AS response, CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END AS response_status,
 CASE WHEN protocol = 2 THEN hmethod END AS http_method, CASE WHEN protocol = 2 THEN hpath END AS http_path, CASE WHEN protocol = 2 THEN hhost END AS http_host,
 CASE WHEN protocol = 8 THEN rcommand END AS redis_command, CASE WHEN protocol = 8 THEN rpayload END AS redis_payload,
 CASE WHEN protocol = 11 THEN k % 3 END AS api_key, CASE WHEN protocol = 11 THEN ['t' || (k % 5), 't' || (k % 3)] END AS req_topics, CASE WHEN protocol = 11 THEN ['t' || ((k + 1) % 5), 't' || ((k + 1) % 3)] END AS resp_topics,
 CASE WHEN protocol = 4 THEN 10 + k % 3 END AS request_code, CASE WHEN protocol = 4 THEN k % 14 END AS language, CASE WHEN protocol = 7 THEN k % 7 END AS txid, CASE WHEN protocol = 7 THEN [hhost, 'alias.' || hhost] END AS dns_names, k
 FROM records_0)"""

MESSAGES = EVENTS + """, messages AS (SELECT user_id AS conn_id, event_type IN ('view', 'click', 'signup') AS is_req, ts_ns, event_id AS seq, 64 + k AS byte_size, k % 9 AS stream_id, k % 25 AS corr_id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) AS packet_id, event_id AS request_id, 'm' || k AS body, event_type, k % 4 AS stmt_id, k FROM events_v)"""

_KERN_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax"
KERN = f"""kern_0 AS (SELECT *, row_number() OVER ({_KERN_ORDER}) AS rn, CAST(round(l_quantity) AS BIGINT) AS len FROM lineitem),
kern AS (SELECT l_orderkey AS conn_id, CAST(rn AS INTEGER) AS rn, l_linenumber % 14 + 1 AS step, CAST(coalesce(sum(len) OVER ({_KERN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq, len,
 epoch_us(l_shipdate) * 1000 + l_partkey * 1000 AS ts_ns, 'eth' || (l_suppkey % 3) AS ifname, l_partkey % 32 AS flags FROM kern_0),
ranges AS (SELECT conn_id, CAST((rn - 1) // 3 AS INTEGER) AS message, min(seq) + 5 AS start, max(seq + len) + 5 AS "end" FROM kern GROUP BY ALL)"""

SEGMENTS = """segments AS (SELECT l_orderkey AS conn_id, 'in' AS direction, CAST(l_linenumber * 25 AS BIGINT) AS seq, CAST(round(l_quantity) AS BIGINT) AS len,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_linenumber, l_discount, l_tax) AS arrival, epoch_us(l_shipdate) * 1000 AS ts_ns FROM lineitem)"""

CONN_EVENTS = EVENTS + """, conn_events AS (SELECT user_id AS tgid_fd, CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'close' ELSE 'protocol_infer' END AS kind, ts_ns, event_id AS seq, CAST(k % 15 AS INTEGER) AS protocol,
 CASE WHEN k % 2 = 0 THEN 'server' ELSE 'client' END AS role FROM events_v WHERE event_type IN ('signup', 'error', 'view')),
connections_0 AS (SELECT tgid_fd, ts_ns AS start_ns, lead(ts_ns) OVER (PARTITION BY tgid_fd ORDER BY ts_ns, seq) AS next_ns FROM conn_events WHERE kind = 'connect'),
connections AS (SELECT tgid_fd, start_ns, next_ns, (SELECT min(x.ts_ns) FROM conn_events x WHERE x.kind = 'close' AND x.tgid_fd = o.tgid_fd AND x.ts_ns > o.start_ns AND (o.next_ns IS NULL OR x.ts_ns <= o.next_ns)) AS close_ns FROM connections_0 o)"""

CONTAINERS = """containers AS (SELECT md5('c' || c_custkey) AS id, '/' || lower(c_name) AS name, 'pod-' || (c_custkey % 50) AS pod, lower(c_mktsegment) AS namespace, c_custkey % 10 = 0 AS sandbox, 1000 + c_custkey % 200 AS root_pid,
 CASE WHEN c_custkey % 23 <> 0 THEN 4026531000 + c_custkey % 97 ELSE 0 END AS pid_ns, CASE WHEN c_custkey % 23 <> 0 THEN 4026532000 + c_custkey % 89 ELSE 0 END AS mnt_ns, CASE WHEN c_custkey % 23 <> 0 THEN 4026533000 + c_custkey % 83 ELSE 0 END AS net_ns FROM customer)"""

PROCESSES = """processes AS (SELECT p_partkey AS pid, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS ppid, '/usr/bin/' || replace(p_name, ' ', '-') AS name, 4026533000 + p_partkey % 83 AS net_ns FROM part)"""

NAT = """nat AS (SELECT '10.0.0.' || (s_suppkey % 16) AS sip, CAST(30000 + s_suppkey AS INTEGER) AS sport, '192.168.' || (s_suppkey % 8) || '.' || (s_suppkey % 10) AS dip, 8002 AS dport, '172.16.' || s_nationkey || '.1' AS to_sip, CAST(40000 + s_suppkey AS INTEGER) AS to_sport,
 '10.9.8.' || (s_suppkey % 200) AS to_dip, 80 AS to_dport FROM supplier)"""
