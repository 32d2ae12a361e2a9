"""Registered queries: names, schemas, plans, sources and streams."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from netlens.plans import load
from netlens.sources import adapters, readers
from netlens.streaming import stats
from netlens.streaming.run import run_available


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "p99" in df.columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(load()[0]) > 110


@pytest.mark.parametrize("name", ["e1_conn", "e5_two_level", "d1_pair_fifo", "d9_connection_of_event", "d10_range_overlap", "f1_islands", "e10_annotate", "d17_unmatched"])
def test_plans(spark, small, name):
    """No nested loops, no products, and no Python in batch plans."""
    plan = load()[0][name](spark, small)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan


def test_group_limit_prunes_samples(spark, small):
    plan = load()[0]["e4_top_samples"](spark, small)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "WindowGroupLimit" in plan


def test_scans_read_few_columns(spark, small):
    plan = load()[0]["c4_remote_port"](spark, small)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double,props:string>" in plan


def test_json_round_trip(spark, small, tmp_path):
    r = adapters.records(spark, small).limit(20)
    readers.write_records_json(r, str(tmp_path / "j"))
    readers.write_records_json(r, str(tmp_path / "j"))
    back = readers.read_records(spark, str(tmp_path / "j"))
    assert back.count() == 40
    want = {(x.start_ns, x.end_ns, x.resp_size) for x in r.collect()}
    assert {(x.start_ns, x.end_ns, x.resp_size_bytes) for x in back.collect()} == want


def test_text_sink(spark, small, tmp_path):
    readers.write_records_text(adapters.records(spark, small).limit(3), str(tmp_path / "t"), limit=8)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert text.count("[ Request ]") == 3


def test_unknown_family(spark):
    with pytest.raises(ValueError):
        readers.read_events(spark, "/nowhere", "other")


def test_event_family(spark, small, tmp_path):
    e = adapters.conn_events(spark, small)
    e.write.parquet(str(tmp_path / "e"))
    assert readers.read_events(spark, str(tmp_path / "e"), "conn").count() == e.count()
    seen = []
    q = readers.for_each_batch(readers.read_events(spark, str(tmp_path / "e"), "conn", streaming=True), lambda df, n: seen.append(df.count()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == e.count()


def test_stream_equals_batch(spark, small):
    records = adapters.records_of(adapters.events_of(adapters.stream(spark, small, "events")))
    a = run_available(stats.cumulative(records, "protocol", "reqsize"), "complete").orderBy("class_id").collect()
    from netlens.operators.stats import stat

    assert a == stat(adapters.records(spark, small), "protocol", "reqsize").orderBy("class_id").collect()


def test_top_merge(spark):
    schema = "class_id string, value double, start_ns long, record_id long"
    known = spark.createDataFrame([("a", 5.0, 1, 1), ("a", 3.0, 2, 2)], schema)
    batch = spark.createDataFrame([("a", 4.0, 3, 3), ("b", 1.0, 4, 4)], schema)
    assert sorted(r.record_id for r in stats.merge_top(known, batch, 2).select("record_id").collect()) == [1, 3, 4]


def test_times_do_not_depend_on_the_zone(spark, small):
    before = adapters.events(spark, small).agg(F.sum(F.col("ts_ns") % 1000003)).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert adapters.events(spark, small).agg(F.sum(F.col("ts_ns") % 1000003)).first()[0] == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
