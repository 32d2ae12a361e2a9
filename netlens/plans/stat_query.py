"""Statistics as a value: presets and flags resolved to one DataFrame expression."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from netlens.operators import stats
from netlens.operators.filters import RecordFilter


@dataclass(frozen=True)
class StatQuery:
    """group_by may be `a/b` for two levels. Of the presets slow wins over bigresp, and that over bigreq; without a preset or a
    grouping connections are grouped, with a preset remote addresses."""

    filter: RecordFilter = field(default_factory=RecordFilter)
    group_by: str | None = None
    metric: str | None = None
    sort_by: str = "name"
    descending: bool = False
    slow: bool = False
    big_req: bool = False
    big_resp: bool = False
    limit: int | None = None

    def resolved(self) -> StatQuery:
        metric = "total-time" if self.slow else "respsize" if self.big_resp else "reqsize" if self.big_req else self.metric or "total-time"
        preset = self.slow or self.big_req or self.big_resp
        return replace(self, metric=metric, group_by=self.group_by or ("remote-ip" if preset else "conn"))

    def run(self, records: DataFrame) -> DataFrame:
        q = self.resolved()
        rows = q.filter.apply(records)
        first, _, second = q.group_by.partition("/")
        table = stats.stat_two_level(rows, first, second, q.metric) if second else stats.stat(rows, first, q.metric)
        table = stats.sorted_stat(table, q.sort_by, q.descending)
        return table.limit(q.limit) if q.limit else table
