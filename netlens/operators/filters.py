"""Record predicates: one conjunction of plain columns, so that what can be pushed to a scan is."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import names

c = F.col


@dataclass(frozen=True)
class RecordFilter:
    """Predicates on records; what is None or empty asks for nothing. A predicate on a protocol's own fields keeps only records of
    that protocol. Sizes and latency are those of the messages."""

    pids: list[int] = field(default_factory=list)
    local_ports: list[int] = field(default_factory=list)
    remote_ports: list[int] = field(default_factory=list)
    remote_ips: list[str] = field(default_factory=list)
    side: str | None = None
    protocol: int | None = None
    known_protocol: bool = False
    min_latency_ms: float | None = None
    min_req_size: int | None = None
    min_resp_size: int | None = None
    http_path: str | None = None
    http_path_prefix: str | None = None
    http_path_regex: str | None = None
    http_methods: list[str] = field(default_factory=list)
    http_host: str | None = None
    redis_commands: list[str] = field(default_factory=list)
    redis_keys: list[str] = field(default_factory=list)
    redis_key_prefix: str | None = None
    kafka_api_keys: list[int] = field(default_factory=list)
    kafka_topic: str | None = None
    kafka_producer: bool = True
    kafka_consumer: bool = True
    rocketmq_codes: list[int] = field(default_factory=list)
    rocketmq_languages: list[int] = field(default_factory=list)
    dns_host: str | None = None

    def conditions(self) -> list[Column]:
        out = []
        for column, values in (("pid", self.pids), ("local_port", self.local_ports), ("remote_port", self.remote_ports), ("remote_addr", self.remote_ips)):
            if values:
                out.append(c(column).isin(values))
        if self.side in ("client", "server"):
            out.append(c("side") == self.side)
        if self.protocol is not None:
            out.append(c("protocol") == self.protocol)
        if self.known_protocol:
            out.append(c("protocol") > 1)
        if self.min_latency_ms is not None and self.min_latency_ms > 0:
            out.append(c("end_ns") - c("start_ns") >= int(self.min_latency_ms * 1_000_000))
        if self.min_req_size is not None and self.min_req_size > 0:
            out.append(c("req_size") >= self.min_req_size)
        if self.min_resp_size is not None and self.min_resp_size > 0:
            out.append(c("resp_size") >= self.min_resp_size)
        out += self._http() + self._redis() + self._queues()
        if self.dns_host:
            out.append(F.coalesce((c("protocol") == names.DNS) & F.exists("dns.names", lambda n: n.startswith(self.dns_host)), F.lit(False)))
        return out

    def _http(self) -> list[Column]:
        path, out = c("http.path"), []
        if self.http_path is not None:
            out.append(path == self.http_path)
        if self.http_path_prefix is not None:
            out.append(path.startswith(self.http_path_prefix))
        if self.http_path_regex is not None:
            out.append(path.rlike(self.http_path_regex))
        if self.http_methods:
            out.append(c("http.method").isin(self.http_methods))
        if self.http_host is not None:
            out.append(c("http.host") == self.http_host)
        return [c("protocol") == names.HTTP, *out] if out else []

    def _redis(self) -> list[Column]:
        key, out = F.substring_index("redis.payload", " ", 1), []
        if self.redis_commands:
            out.append(c("redis.command").isin([x.upper() for x in self.redis_commands]))
        if self.redis_keys:
            out.append(key.isin(self.redis_keys))
        if self.redis_key_prefix is not None:
            out.append(key.startswith(self.redis_key_prefix))
        return [c("protocol") == names.REDIS, *out] if out else []

    def _queues(self) -> list[Column]:
        out = []
        if self.kafka_api_keys:
            out += [c("protocol") == names.KAFKA, c("kafka.api_key").isin(self.kafka_api_keys)]
        if self.kafka_topic is not None:
            has = lambda topics: F.exists(topics, lambda t: t == self.kafka_topic)
            wanted = F.when(c("kafka.api_key") == 0, has("kafka.req_topics") if self.kafka_producer else F.lit(False)).when(c("kafka.api_key") == 1, has("kafka.resp_topics") if self.kafka_consumer else F.lit(False)).otherwise(F.lit(False))
            out += [c("protocol") == names.KAFKA, wanted]
        if self.rocketmq_codes:
            out.append(c("rocketmq.request_code").isin(self.rocketmq_codes))
        if self.rocketmq_languages:
            out.append(c("rocketmq.language").isin(self.rocketmq_languages))
        return out

    def apply(self, records: DataFrame) -> DataFrame:
        conditions = self.conditions()
        return records.where(reduce(lambda a, b: a & b, conditions)) if conditions else records


def by_process_name(records: DataFrame, processes: DataFrame, name: str) -> DataFrame:
    """Records of processes with this name, or whose path holds /name."""
    wanted = processes.where((c("name") == name) | c("name").contains("/" + name)).select("pid")
    return records.join(wanted, "pid", "left_semi")


def without_local_port(connections: DataFrame) -> DataFrame:
    """Connections with local port 0 go."""
    return connections.where(c("local_port") != 0)


def traceable(connections: DataFrame, protocols: list[int] | None = None, side: str | None = None) -> DataFrame:
    """Connections of a wanted protocol and side; without a wish, of any known protocol."""
    rows = connections.where(c("protocol").isin(protocols)) if protocols else connections.where(c("protocol") > 1)
    return rows.where(c("role") == side) if side in ("client", "server") else rows


def with_payload(kern: DataFrame) -> DataFrame:
    """Packet events without bytes (handshakes) go."""
    return kern.where(c("len") > 0)
