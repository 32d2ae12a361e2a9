"""Protocols as values: how their messages pair, what is read from them, how their records are classed. New ones can be registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import names
from netlens.operators import pairing, stats

#: Rules by which requests and responses become pairs.
MATCHERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fifo": pairing.pair_fifo, "stream": pairing.pair_by_stream, "correlation": pairing.pair_by_correlation, "opaque": pairing.pair_by_opaque, "queued": pairing.pair_queued,
}


@dataclass(frozen=True)
class ProtocolSpec:
    """extract: columns to add to a pair, by name; filters: conditions that its pairs have to meet; classifier: the class of a record, by
    which statistics can group under the protocol's name. Columns only, so a protocol costs no Python in tasks."""

    name: str
    code: int
    match: str
    extract: dict[str, Callable[[], Column]] = field(default_factory=dict)
    filters: list[Callable[[], Column]] = field(default_factory=list)
    classifier: Callable[[], Column] | None = None

    def pairs(self, messages: DataFrame) -> DataFrame:
        out = MATCHERS[self.match](messages).withColumn("protocol", F.lit(self.code))
        out = out.withColumns({n: make() for n, make in self.extract.items()}) if self.extract else out
        for condition in self.filters:
            out = out.where(condition())
        return out


PROTOCOLS: dict[str, ProtocolSpec] = {}


def register(spec: ProtocolSpec) -> ProtocolSpec:
    if spec.match not in MATCHERS:
        raise ValueError(f"no rule {spec.match!r}; there are {', '.join(MATCHERS)}")
    PROTOCOLS[spec.name] = spec
    if spec.classifier:
        stats.CLASSIFIERS[spec.name] = spec.classifier
    return spec


def _latency() -> dict[str, Callable[[], Column]]:
    return {"latency_ns": lambda: F.col("resp_ts") - F.col("req_ts")}


for _name, _code, _match in (("http", names.HTTP, "fifo"), ("redis", names.REDIS, "fifo"), ("kafka", names.KAFKA, "correlation"), ("rocketmq", names.ROCKETMQ, "opaque"), ("dns", names.DNS, "queued"), ("mongodb", names.MONGO, "stream")):
    register(ProtocolSpec(_name, _code, _match, _latency()))
