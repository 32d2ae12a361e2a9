"""Percentiles from a histogram of powers of two: plain counters, so partial aggregation stays small."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the buckets, and what a rank in the overflow bucket reports.
BOUNDS = [1 << i for i in range(13)]
OVERFLOW = 8192.0


def counters(value: Column) -> list[Column]:
    """Aggregates h0..h13: values up to each bound and above the one before it, and the overflow. Nulls are not counted."""
    out = []
    for i, high in enumerate(BOUNDS):
        inside = value <= high if i == 0 else (value > BOUNDS[i - 1]) & (value <= high)
        out.append(F.count_if(inside).alias(f"h{i}"))
    return [*out, F.count_if(value > BOUNDS[-1]).alias(f"h{len(BOUNDS)}")]


def cumulated(df: DataFrame) -> DataFrame:
    """df with the counters h0..h13 turned into running sums c0..c13, in a projection of their own so that percentiles stay small
    expressions."""
    n = len(BOUNDS) + 1
    sums = {f"c{i}": reduce(add, [F.col(f"h{k}") for k in range(i + 1)]) for i in range(n)}
    return df.withColumns(sums).drop(*[f"h{i}" for i in range(n)])


def percentile(hundredths: int) -> Column:
    """Percentile from cumulated() counters: the bucket that holds the rank ceil(p * n), and a straight line inside it. No value: 0."""
    c = [F.col(f"c{i}") for i in range(len(BOUNDS) + 1)]
    rank = F.floor((c[-1] * hundredths + 99) / F.lit(100))
    out = F.when(c[-1] == 0, F.lit(0.0))
    for i, high in enumerate(BOUNDS):
        low, count = (BOUNDS[i - 1], c[i] - c[i - 1]) if i else (0, c[0])
        out = out.when(c[i] >= rank, (F.lit(1.0) - (c[i] - rank) / count) * F.lit(float(high - low)) + F.lit(float(low)))
    return out.otherwise(F.lit(OVERFLOW))


def histogram(value: Column) -> Column:
    """The same counters as one array, for SQL and for merging."""
    return F.array(*counters(value))
