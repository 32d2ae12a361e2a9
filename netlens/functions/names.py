"""Codes and their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol codes, with the names that are shown (a protocol without one is shown as empty text).
HTTP, MYSQL, DNS, REDIS, MONGO, KAFKA, ROCKETMQ = 2, 4, 7, 8, 10, 11, 14
PROTOCOL_NAMES = {HTTP: "HTTP", REDIS: "Redis", MYSQL: "MySQL", MONGO: "Mongo", ROCKETMQ: "RocketMQ", KAFKA: "Kafka"}
# Names of the steps of a packet, in order; up to LAST_EGRESS it leaves the host.
STEPS = ["Start", "SSLWrite", "System Call(Out)", "TCP Layer(Out)", "IP Layer(Out)", "QDISC", "DEV Layer(Out)", "NIC(Out)", "NIC(In)", "DEV Layer(In)", "IP Layer(In)", "TCP Layer(In)", "User Data Copy", "System Call(In)", "SSLRead", "End"]
SYSCALL_OUT, TCP_OUT, DEV_OUT, NIC_OUT, NIC_IN, DEV_IN, IP_IN, TCP_IN, USER_COPY, SYSCALL_IN = 2, 3, 6, 7, 8, 9, 10, 11, 12, 13
LAST_EGRESS = 7
# Response status.
NONE, SUCCESS, FAIL, UNKNOWN = 0, 1, 2, 3
# Languages of RocketMQ clients, in order of their codes.
ROCKETMQ_LANGUAGES = ["JAVA", "CPP", "DOTNET", "PYTHON", "DELPHI", "ERLANG", "RUBY", "OTHER", "HTTP", "GO", "PHP", "OMS", "RUST", "NODE_JS"]
# Kafka request kinds, in order of their keys.
KAFKA_KEYS = [
    "Produce", "Fetch", "ListOffsets", "Metadata", "LeaderAndIsr", "StopReplica", "UpdateMetadata", "ControlledShutdown", "OffsetCommit", "OffsetFetch", "FindCoordinator", "JoinGroup", "Heartbeat",
    "LeaveGroup", "SyncGroup", "DescribeGroups", "ListGroups", "SaslHandshake", "ApiVersions", "CreateTopics", "DeleteTopics", "DeleteRecords", "InitProducerId", "OffsetForLeaderEpoch", "AddPartitionsToTxn",
    "AddOffsetsToTxn", "EndTxn", "WriteTxnMarkers", "TxnOffsetCommit", "DescribeAcls", "CreateAcls", "DeleteAcls", "DescribeConfigs", "AlterConfigs", "AlterReplicaLogDirs", "DescribeLogDirs", "SaslAuthenticate", "CreatePartitions",
    "CreateDelegationToken", "ReneDelegationToken", "ExpireDelegationToken", "DescribeDelegationToken", "DeleteGroups", "ElectLeaders", "IncrementalAlterConfigs", "AlterPartitionReassignments",
    "ListPartitionReassignments", "OffsetDelete", "DescribeClientQuotas", "AlterClientQuotas", "DescribeUserScramCredentials", "AlterUserScramCredentials",
]
# Request kinds with greater keys; there are none between.
KAFKA_LATER_KEYS = {56: "AlterIsr", 57: "UpdateFeatures", 60: "DescribeCluster", 61: "DescribeProducers"}
# Highest version of any Kafka request; least version and first flexible version (none: null) of each kind, by key.
KAFKA_MAX_VERSION = 17
KAFKA_LEAST_VERSIONS = {0: 1}
KAFKA_FLEXIBLE_FROM = [9, 12, 6, 9, 4, 2, 6, 3, 8, 6, 3, 6, 4, 4, 4, 5, 3, None, 3, 5, 4, 2, 2, 4, 3, 3, 3, 1, 3, 2, 2, 2, 4, 2, 2, 2, 2, 2, 2, 2, 2, 2, 5, 2, 1, 0, 0, None, 1, 1, 0, 0]
KAFKA_LATER_FLEXIBLE_FROM = {56: 0, 57: 0, 60: 0, 61: 0}
# TCP flag masks.
TCP_FLAGS = {"ACK": 16, "PSH": 8, "RST": 4, "SYN": 2}
# First words of Redis commands of two words.
REDIS_TWO_WORDS = ["ACL", "CLIENT", "CLUSTER", "COMMAND", "CONFIG", "DEBUG", "LATENCY", "MEMORY", "MODULE", "REPLCONF", "SCRIPT"]


def _looked_up(code: Column, names: dict[int, str] | list[str], default: Column) -> Column:
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    out = None
    for k, v in pairs:
        out = F.when(code == k, F.lit(v)) if out is None else out.when(code == k, F.lit(v))
    return out.otherwise(default)


def protocol_name(code: Column) -> Column:
    return _looked_up(code, PROTOCOL_NAMES, F.lit(""))


def protocol_code(name: Column) -> Column:
    out = None
    for k, v in PROTOCOL_NAMES.items():
        out = F.when(name == v, F.lit(k)) if out is None else out.when(name == v, F.lit(k))
    return out


def side_name(code: Column) -> Column:
    return _looked_up(code, ["all", "server", "client"], F.lit("all"))


def step_name(code: Column) -> Column:
    return _looked_up(code, STEPS, F.lit(""))


def direction(step: Column) -> Column:
    return F.when(step <= LAST_EGRESS, F.lit("egress")).otherwise(F.lit("ingress"))


def black_box_name(side: Column) -> Column:
    """What the opaque part of a request is called: on the server it is the process, for a client the network."""
    return F.when(side == "server", F.lit("process internal duration")).otherwise(F.lit("network duration"))


def syscall_name(side: Column, is_request: Column) -> Column:
    """A server reads requests and writes responses, a client the other way round."""
    return F.when((side == "server") == is_request, F.lit("read")).otherwise(F.lit("write"))


def rocketmq_language(code: Column) -> Column:
    return _looked_up(code, ROCKETMQ_LANGUAGES, F.lit("UNKNOWN"))


def rocketmq_language_code(name: Column) -> Column:
    out = None
    for k, v in enumerate(ROCKETMQ_LANGUAGES):
        out = F.when(F.upper(name) == v, F.lit(k)) if out is None else out.when(F.upper(name) == v, F.lit(k))
    return out


def kafka_key_name(code: Column) -> Column:
    return _looked_up(code, dict(enumerate(KAFKA_KEYS)) | KAFKA_LATER_KEYS, F.lit("Unknown"))


def kafka_supported(code: Column, version: Column) -> Column:
    least = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in KAFKA_LEAST_VERSIONS.items()], F.lit(0))
    return (code.between(0, len(KAFKA_KEYS) - 1) | code.isin(*KAFKA_LATER_KEYS)) & (version >= least) & (version <= KAFKA_MAX_VERSION)


def kafka_flexible(code: Column, version: Column) -> Column:
    later = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in KAFKA_LATER_FLEXIBLE_FROM.items()])
    first = F.coalesce(F.get(F.array(*[F.lit(v).cast("int") for v in KAFKA_FLEXIBLE_FROM]), code), later)
    return F.coalesce(version >= first, F.lit(False))


def tcp_flags(flags: Column) -> Column:
    """Names of the set flags, joined by |."""
    return F.concat_ws("|", *[F.when(flags.bitwiseAND(F.lit(m)) != 0, F.lit(n)) for n, m in TCP_FLAGS.items()])
