"""Long groups in blocks: the same rows as windows, and no group in one block."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netlens.operators import connections, pairing, ranges, reassembly, scan

MESSAGES = "conn_id long, stream_id long, ts_ns long, seq long, is_req boolean, byte_size long, packet_id int, head int"


def same(a, b):
    assert a.columns == b.columns
    a, b = (sorted(map(tuple, x.collect()), key=str) for x in (a, b))
    assert a == b and a


@pytest.fixture(scope="module")
def messages(spark):
    """Connection 0 has half of all rows; times repeat."""
    rng = random.Random(3)
    data = [(0 if k % 2 else rng.randint(1, 20), rng.randint(0, 1), rng.randint(0, 900), k, rng.random() < 0.5, rng.randint(1, 99), rng.randint(1, 3), rng.choice([0, 7, 255])) for k in range(3000)]
    return spark.createDataFrame(data, MESSAGES)


@pytest.mark.parametrize("blocks", [2, 9])
def test_pairs(messages, blocks):
    same(pairing.pair_fifo(messages, blocks), pairing.pair_fifo(messages))
    same(pairing.pair_by_stream(messages, blocks), pairing.pair_by_stream(messages))
    same(pairing.pair_queued(messages, ("conn_id",), blocks), pairing.pair_queued(messages, ("conn_id",)))
    same(pairing.group_response_runs(messages, blocks), pairing.group_response_runs(messages))


def test_lookups_and_ranges(spark, messages):
    rng = random.Random(4)
    kinds = [(rng.randint(0, 5), rng.choice(["connect", "close"]), rng.randint(0, 900), k) for k in range(400)]
    lives = connections.lifecycles(spark.createDataFrame(kinds, "tgid_fd long, kind string, ts_ns long, seq long"))
    events = messages.select(F.col("conn_id").alias("tgid_fd"), "ts_ns", "seq")
    same(connections.lookup(events, lives, 9), connections.lookup(events, lives))
    seg = messages.select("conn_id", F.lit("in").alias("direction"), (F.col("ts_ns") * 30 + F.when(F.col("ts_ns") > 450, 1 << 21).otherwise(0)).alias("seq"), F.col("byte_size").alias("len"), F.col("seq").alias("arrival"), "ts_ns")
    same(reassembly.islands(seg, blocks=9), reassembly.islands(seg))
    offsets = seg.select("conn_id", (F.col("seq") + 3).alias("seq")).distinct()
    same(ranges.time_of_offset(offsets, seg, blocks=9), ranges.time_of_offset(offsets, seg))


def test_a_long_group_lies_in_many_blocks(spark, messages):
    w = Window.partitionBy("conn_id").orderBy("ts_ns", "seq")
    got = scan.running(messages, ["conn_id"], ["ts_ns", "seq"], {"n": ("sum", F.lit(1), True), "most": ("max", F.col("byte_size"), False), "least": ("min", F.col("byte_size"), True)}, 8)
    want = messages.withColumns({"n": F.sum(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "most": F.max("byte_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), "least": F.min("byte_size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    same(got, want)
    spread = messages.repartitionByRange(8, "conn_id", "ts_ns", "seq").withColumn("b", F.spark_partition_id()).groupBy("conn_id", "b").count()
    sizes = [r["count"] for r in spread.where("conn_id = 0").collect()]
    assert len(sizes) >= 4 and max(sizes) < 3000 / 8 * 1.6
    assert scan.running(messages.limit(0), ["conn_id"], ["ts_ns"], {"n": ("sum", F.lit(1), True)}, 4).count() == 0


def test_partitions_grow_with_the_table(spark, small):
    """Segments lie in as many partitions as their table's rows ask for, and streams put together in many partitions are the same."""
    from netlens.operators import reassembly, scratch
    from netlens.sources import adapters

    lines = adapters.table(spark, small, "lineitem")
    assert scratch.parts_of(lines, 500) == -(-lines.count() // 500) and scratch.parts_of(lines, 10**9) == 4
    s = adapters.segments(spark, small).withColumn("payload", F.unhex(F.expr("repeat(lpad(hex(arrival % 256), 2, '0'), int(len))")))
    got = [sorted(map(tuple, reassembly.reassemble(s, parts=parts).select("conn_id", "start", F.hex("payload")).collect())) for parts in (None, 9)]
    assert got[0] == got[1] and len(got[0]) > 1000
