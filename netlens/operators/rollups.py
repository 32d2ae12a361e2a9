"""Statistics as states that are stored and merged: hours become days, and windows of a stream become the whole."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions import histogram, names
from netlens.operators import stats

c = F.col

#: Size of a quantile sketch: its rank error is about 0.9 % at 300, whatever the number of values, and also after merging.
SKETCH_K = 300
BUCKETS = len(histogram.BOUNDS) + 1


def sketch(value: Column, k: int = SKETCH_K) -> Column:
    return F.kll_sketch_agg_double(value.cast("double"), k)


def state_columns(k: int = SKETCH_K) -> list[Column]:
    """What a class's state holds: counts, extremes and sums of `_value`, the 14 counters as an array, and a quantile sketch."""
    v = c("_value")
    return [F.count(F.lit(1)).alias("count"), F.count_if(c("response_status") != names.SUCCESS).alias("failed_count"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.count(v).alias("n"), histogram.histogram(v).alias("h"), sketch(v, k).alias("sketch")]


def states(records: DataFrame, group_by: str = "conn", metric: str = "total-time", seconds: int | None = None, k: int = SKETCH_K) -> DataFrame:
    """(class_id[, window_us], count, failed_count, max, sum, n, h, sketch) of each class, or of each class in each window of `seconds` by the
    time when records start. One partial aggregate: a hot class costs each task one row of some kilobytes."""
    rows = stats._base(records, metric).withColumn("class_id", stats.CLASSIFIERS[group_by]())
    keys = ["class_id"]
    if seconds:
        rows = rows.withColumn("window_us", F.expr(f"start_ns div {seconds * 1_000_000_000} * {seconds * 1_000_000}"))
        keys.append("window_us")
    return rows.groupBy(*keys).agg(*state_columns(k))


def merged(stored: DataFrame, *by: str) -> DataFrame:
    """States by coarser keys, columns of `stored`. Merging states gives what one pass over all records gives: counters to the last
    number, sketches within their error. States with another k merge, too; the error is that of the smallest."""
    h = F.array(*(F.sum(F.get("h", F.lit(i))) for i in range(BUCKETS)))
    return stored.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("failed_count").alias("failed_count"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("n").alias("n"), h.alias("h"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(column: str, n: Column, *hundredths: int) -> dict[str, Column]:
    """p50 and so on from a sketch; null where it has seen no value."""
    at = F.array(*(F.lit(p / 100) for p in hundredths))
    got = F.when(n > 0, F.kll_sketch_get_quantile_double(column, at))
    return {f"p{p}": F.get(got, F.lit(i)) for i, p in enumerate(hundredths)}


def measured(stored: DataFrame, total: bool = False, approx: bool = False) -> DataFrame:
    """The measures of stat() from states, percentiles from the counters or, with approx=True, from the sketches."""
    keys = [k for k in stored.columns if k not in ("count", "failed_count", "max", "sum", "n", "h", "sketch")]
    if approx:
        p = quantiles("sketch", c("n"), 50, 90, 99)
        out = stored
    else:
        out = stored.withColumns({f"c{i}": reduce(add, [F.get("h", F.lit(j)) for j in range(i + 1)]) for i in range(BUCKETS)})
        p = {f"p{x}": histogram.percentile(x) for x in (50, 90, 99)}
    made = [*keys, "count", "failed_count", "max", (c("sum") / c("n")).alias("avg"), *(x.alias(k) for k, x in p.items())]
    return out.select(*made, *([c("sum").alias("total")] if total else []))
