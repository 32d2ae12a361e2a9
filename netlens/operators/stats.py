"""Grouped statistics: counts, extremes, averages, histogram percentiles, top samples, two-level groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions import histogram, names, scalars
from netlens.operators.scratch import written

c = F.col

# Class of records that a protocol's own classifier does not fit.
NOT_HTTP, NOT_REDIS = "_not_a_http_req_", "_not_a_redis_req_"


def _http_path() -> Column:
    return F.when(c("protocol") == names.HTTP, c("http.path")).otherwise(F.lit(NOT_HTTP))


def _redis_command() -> Column:
    return F.when(c("protocol") == names.REDIS, c("redis.command")).otherwise(F.lit(NOT_REDIS))


#: Classifiers by name; more can be added as functions that return a column of text.
CLASSIFIERS: dict[str, Callable[[], Column]] = {
    "none": lambda: F.lit("none"),
    "conn": lambda: c("conn_id"),
    "remote-port": lambda: c("remote_port").cast("string"),
    "local-port": lambda: c("local_port").cast("string"),
    "remote-ip": lambda: c("remote_addr"),
    "protocol": lambda: c("protocol").cast("string"),
    "http-path": _http_path,
    "redis-command": _redis_command,
    "protocol-adaptive": lambda: F.when(c("protocol") == names.HTTP, c("http.path")).when(c("protocol") == names.REDIS, c("redis.command")).otherwise(c("remote_addr")),
}

#: Metrics by name: a column, and the side whose records have it. Times are in ms, sizes in bytes.
METRICS: dict[str, tuple[Callable[[], Column], str | None]] = {
    "total-time": (lambda: scalars.ns_to_ms(c("total_ns")), None),
    "reqsize": (lambda: c("req_size").cast("double"), None),
    "respsize": (lambda: c("resp_size").cast("double"), None),
    "network-time": (lambda: scalars.ns_to_ms(c("black_box_ns")), "client"),
    "internal-time": (lambda: scalars.ns_to_ms(c("black_box_ns")), "server"),
    "socket-time": (lambda: scalars.ns_to_ms(c("read_socket_ns")), None),
}
SIZES = ("reqsize", "respsize")


def _base(records: DataFrame, metric: str) -> DataFrame:
    value, side = METRICS[metric]
    rows = records.where(c("side") == side) if side else records
    return rows.withColumn("_value", value())


def aggregates() -> list[Column]:
    v = c("_value")
    return [F.count(F.lit(1)).alias("count"), F.count_if(c("response_status") != names.SUCCESS).alias("failed_count"), F.max(v).alias("max"), F.sum(v).alias("_sum"), F.count(v).alias("_n"), *histogram.counters(v)]


def measures(total: bool) -> list[Column]:
    out = [c("count"), c("failed_count"), c("max"), (c("_sum") / c("_n")).alias("avg"), *[histogram.percentile(p).alias(f"p{p}") for p in (50, 90, 99)]]
    return [*out, c("_sum").alias("total")] if total else out


def stat(records: DataFrame, group_by: str = "conn", metric: str = "total-time", exact: bool = False, approx: bool = False) -> DataFrame:
    """One row for each class: class_id, count, failed_count, max, avg, p50, p90, p99, and total for sizes.

    Percentiles come from 14 counters for each class, so a hot class costs one small row from each task. approx=True takes them from a
    quantile sketch instead, which holds a bounded number of values of a class and is as near in every range (rollups.SKETCH_K);
    exact=True takes all values, those of a class in one task. Records without the metric count but have no value.
    """
    if approx:
        from netlens.operators import rollups

        return rollups.measured(rollups.states(records, group_by, metric), metric in SIZES, approx=True)
    rows = _base(records, metric).withColumn("class_id", CLASSIFIERS[group_by]())
    if exact:
        extra = [F.percentile("_value", F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 99)]
        out = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("count"), F.count_if(c("response_status") != names.SUCCESS).alias("failed_count"), F.max("_value").alias("max"), F.avg("_value").alias("avg"), *extra, F.sum("_value").alias("total"))
        return out if metric in SIZES else out.drop("total")
    return histogram.cumulated(rows.groupBy("class_id").agg(*aggregates())).select("class_id", *measures(metric in SIZES))


def stat_two_level(records: DataFrame, group_by: str, sub_group_by: str, metric: str = "total-time") -> DataFrame:
    """Rows for classes and, with is_sub, for classes and sub-classes, in one pass of grouping sets."""
    rows = _base(records, metric).withColumns({"class_id": CLASSIFIERS[group_by](), "sub_id": CLASSIFIERS[sub_group_by]()})
    out = rows.groupingSets([["class_id"], ["class_id", "sub_id"]], "class_id", "sub_id").agg(*aggregates(), F.grouping("sub_id").alias("_whole"))
    out = histogram.cumulated(out)
    full = F.when(c("_whole") == 0, F.concat_ws("||", "class_id", "sub_id")).otherwise(c("class_id"))
    return out.select(c("class_id").alias("parent_id"), full.alias("class_id"), (c("_whole") == 0).alias("is_sub"), *measures(metric in SIZES))


def drill_down(two_level: DataFrame, parent: str) -> DataFrame:
    return two_level.where(c("is_sub") & (c("parent_id") == parent))


def overview(records: DataFrame, metric: str = "total-time") -> DataFrame:
    """Remote addresses and what is asked of them, with the protocol of the record that has the smallest metric."""
    rows = _base(records, metric).withColumns({"class_id": CLASSIFIERS["remote-ip"](), "sub_id": CLASSIFIERS["protocol-adaptive"]()})
    out = rows.groupingSets([["class_id"], ["class_id", "sub_id"]], "class_id", "sub_id").agg(*aggregates(), F.grouping("sub_id").alias("_whole"), F.min_by("protocol", F.struct("_value", "start_ns", "record_id")).alias("_protocol"))
    out = histogram.cumulated(out)
    full = F.when(c("_whole") == 0, F.concat_ws("||", "class_id", "sub_id")).otherwise(c("class_id"))
    return out.select(full.alias("class_id"), (c("_whole") == 0).alias("is_sub"), names.protocol_name(c("_protocol")).alias("protocol"), *measures(metric in SIZES))


def top_samples(records: DataFrame, group_by: str = "conn", metric: str = "total-time", k: int = 10) -> DataFrame:
    """The k records of each class with the greatest metric, and their rank; of equal ones the earlier stays. k <= 0 means 10."""
    rows = _base(records, metric).withColumn("class_id", CLASSIFIERS[group_by]()).where("_value is not null")
    order = Window.partitionBy("class_id").orderBy(c("_value").desc(), "start_ns", "record_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(c("rank") <= (k if k > 0 else 10)).withColumnRenamed("_value", "value")


def samples_view(samples: DataFrame) -> DataFrame:
    return samples.orderBy(c("value").desc(), "class_id", "rank")


def class_labels(records: DataFrame, group_by: str = "conn") -> DataFrame:
    """The human label of each class: that of its first record."""
    label = {"conn": scalars.connection_label(c("local_addr"), c("local_port"), c("remote_addr"), c("remote_port"), c("side")), "protocol": names.protocol_name(c("protocol"))}.get(group_by)
    rows = records.withColumn("class_id", CLASSIFIERS[group_by]())
    return rows.groupBy("class_id").agg(F.min_by(label if label is not None else c("class_id"), F.struct("start_ns", "record_id")).alias("label"))


#: Columns that a stat table can be sorted by.
SORTS = {"name": "class_id", "protocol": "protocol", "max": "max", "avg": "avg", "p50": "p50", "p90": "p90", "p99": "p99", "count": "count", "total": "total"}


def sorted_stat(table: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    key = c(SORTS[by])
    return table.orderBy(key.desc() if descending else key.asc(), "class_id")


def numbered(table: DataFrame, *order: Column | str) -> DataFrame:
    """Row numbers from 1 in an order: ranges of rows are numbered each for itself, and begin after the rows of those before them."""
    ranges = written(table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rows = ranges.withColumn("_no", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return rows.join(F.broadcast(starts), "_range").withColumn("no", c("_no") + c("_before")).drop("_range", "_no", "_before")
