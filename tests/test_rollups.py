"""States of statistics: sketches within their error, merging, SQL functions."""

import random

import pytest
from pyspark.sql import functions as F

from netlens.functions import sql
from netlens.operators import rollups, stats

RECORDS = "remote_addr string, start_ns long, total_ns long, response_status int, side string"


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(5)
    draw = {"a": lambda: rng.lognormvariate(3, 2), "b": lambda: rng.randint(1, 4), "c": lambda: rng.random() * 9000, "d": lambda: 7.0}
    data = [(k, i * 1_000_000_000, int(draw[k]() * 1e6), 1 + (i % 7 == 0), "client") for i, k in enumerate(rng.choices("aaabcd", k=60_000))]
    data += [("e", 5, None, 1, "client"), ("e", 6, None, 2, "client")]
    return spark.createDataFrame(data, RECORDS)


def ranks(records, told):
    """For each class and percentile: the shares of values below it, and up to it."""
    values = {}
    for r in records.where("total_ns is not null").collect():
        values.setdefault(r.remote_addr, []).append(r.total_ns / 1e6)
    return {(r.class_id, p): (sum(v < r[p] for v in values[r.class_id]) / len(values[r.class_id]), sum(v <= r[p] for v in values[r.class_id]) / len(values[r.class_id])) for r in told if r.class_id in values for p in ("p50", "p90", "p99")}


def test_sketches_are_near_and_merge(records):
    whole = stats.stat(records, "remote-ip", approx=True).collect()
    merged = rollups.measured(rollups.merged(rollups.states(records, "remote-ip", seconds=3600), "class_id"), approx=True).collect()
    for told in (whole, merged):
        got = ranks(records, told)
        assert len(got) == 12
        for (_, p), (below, up_to) in got.items():
            assert below - 0.02 <= int(p[1:]) / 100 <= up_to + 0.02
        none = next(r for r in told if r.class_id == "e")
        assert (none["count"], none.failed_count, none.max, none.p50) == (2, 1, None, None)


def test_merged_counters_are_those_of_one_pass(records):
    near = lambda rows: sorted((r.class_id, r["count"], r.failed_count, r.max, r.avg and round(r.avg, 6), r.p50, r.p90, r.p99) for r in rows)
    hours = rollups.states(records, "remote-ip", seconds=3600)
    assert hours.count() > 4 * 15
    days = rollups.merged(hours.withColumn("day", F.expr("window_us div 86400000000")), "class_id", "day")
    assert near(rollups.measured(rollups.merged(days, "class_id")).collect()) == near(stats.stat(records, "remote-ip").collect())


def test_sql_functions(spark, records):
    sql.register(sql.register(spark))  # twice is no harm
    rows = spark.sql("""SELECT remote_addr AS class_id, netlens_percentile(h, 50) AS p50, netlens_percentile(h, 90) AS p90, netlens_percentile(h, 99) AS p99 FROM (
        SELECT remote_addr, netlens_counters(collect_list(struct(bucket, n))) AS h FROM (SELECT remote_addr, netlens_bucket(total_ns / 1e6) AS bucket, count(total_ns) AS n FROM {r} GROUP BY ALL) GROUP BY remote_addr)""", r=records).collect()
    want = stats.stat(records, "remote-ip").collect()
    assert sorted((r.class_id, r.p50, r.p90, r.p99) for r in rows) == sorted((r.class_id, r.p50, r.p90, r.p99) for r in want)
    one = spark.sql("SELECT netlens_bucket(1.0) a, netlens_bucket(1.5) b, netlens_bucket(4096.0) c, netlens_bucket(4097.0) d, netlens_bucket(NULL) e, netlens_merge(array(1L, 2L), array(5L)) m, netlens_percentile(array_repeat(0L, 14), 50) z").first()
    assert (one.a, one.b, one.c, one.d, one.e, one.z) == (0, 1, 12, 13, None, 0.0) and one.m == [6, 2] + [0] * 12
