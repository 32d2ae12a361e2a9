"""Fixed schemas. Nanosecond times are longs; what is absent is null, never a sentinel."""

from __future__ import annotations

_EVENTS = "array<struct<ByteSize:bigint,Timestamp:bigint>>"
_NIC_EVENTS = "array<struct<ByteSize:bigint,Timestamp:bigint,Attributes:map<string,bigint>>>"

#: One annotated request/response pair.
RECORD_SCHEMA = (
    "record_id long, conn_id string, local_addr string, local_port int, remote_addr string, remote_port int, pid long, "
    "protocol int, side string, is_ssl boolean, start_ns long, end_ns long, total_ns double, black_box_ns double, "
    "read_socket_ns double, copy_to_sock_ns double, req_size long, resp_size long, req_plain_size long, resp_plain_size long, "
    "request string, response string, response_status int, http struct<method:string,path:string,host:string>, "
    "redis struct<command:string,payload:string>, kafka struct<api_key:int,req_topics:array<string>,resp_topics:array<string>>, "
    "rocketmq struct<request_code:int,language:int>, dns struct<txid:int,names:array<string>>, "
    f"req_syscall_events {_EVENTS}, resp_syscall_events {_EVENTS}, req_nic_events {_NIC_EVENTS}, resp_nic_events {_NIC_EVENTS}"
)

#: The exported form, one JSON object for each record.
JSON_RECORD_SCHEMA = (
    "start_time string, end_time string, protocol string, side string, local_addr string, local_port int, remote_addr string, "
    "remote_port int, pid long, is_ssl boolean, total_duration_ms double, black_box_duration_ms double, "
    "read_socket_duration_ms double, copy_to_socket_buffer_duration_ms double, req_size_bytes long, resp_size_bytes long, "
    "req_plain_text_size_bytes long, resp_plain_text_size_bytes long, request string, response string, "
    f"req_syscall_events {_EVENTS}, resp_syscall_events {_EVENTS}, req_nic_events {_NIC_EVENTS}, resp_nic_events {_NIC_EVENTS}"
)

CONN_EVENT_SCHEMA = ("tgid_fd long, kind string, ts_ns long, local_addr string, local_port int, remote_addr string, remote_port int, protocol int, "
                     "role string, read_bytes long, write_bytes long, is_ssl boolean")
KERN_EVENT_SCHEMA = "tgid_fd long, step byte, seq long, len long, ts_ns long, ts_delta long, flags int, ifname string"
SEGMENT_SCHEMA = "tgid_fd long, direction string, seq long, arrival long, ts_ns long, ts_delta long, buf_size long, payload binary, source_fn int"
SSL_EVENT_SCHEMA = SEGMENT_SCHEMA + ", syscall_seq long, syscall_len long"
FIRST_PACKET_SCHEMA = "local_addr string, local_port int, remote_addr string, remote_port int, ts_ns long, len long, flags int, ifname string, step byte"
PROCESS_EVENT_SCHEMA = "pid long, ppid long, kind string, name string, net_ns long, ts_ns long"
CONTAINER_SCHEMA = "id string, name string, labels string, root_pid long, pid_ns long, mnt_ns long, net_ns long, image string"

#: Event families that read_events() knows.
FAMILIES = {"conn": CONN_EVENT_SCHEMA, "kern": KERN_EVENT_SCHEMA, "syscall": SEGMENT_SCHEMA, "ssl": SSL_EVENT_SCHEMA, "first_packet": FIRST_PACKET_SCHEMA, "proc": PROCESS_EVENT_SCHEMA}
