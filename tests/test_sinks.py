"""The JSON sink and the event source of a stream, over a failure in the middle and a restart."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from netlens.schemas import FAMILIES
from netlens.sources import readers

RECORDS = "record_id long, start_ns long, end_ns long, protocol int, side string, local_addr string, local_port int, remote_addr string, remote_port int, pid long, is_ssl boolean, total_ns double, req_size long, resp_size long, request string, response string"


def test_restart_loses_and_doubles_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in range(5):
        rows = [(part * 10 + k, 1_700_000_000_000_000_000 + k, 1_700_000_000_000_001_000 + k, 2, "client", "a", 1, "b", 2, 7, False, 5.0, 1, 2, f"r{part * 10 + k}", "x") for k in range(10)]
        spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    flag = f"{folder}/broken"
    open(flag, "w").close()

    @F.udf("string")
    def fragile(text):
        if text == "r25" and os.path.exists(flag):
            raise ValueError("the disk is gone")
        return text

    kind = spark.createDataFrame([], RECORDS).schema
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("request", fragile("request"))
    with pytest.raises(Exception, match="the disk is gone"):
        readers.stream_records_json(stream(), f"{folder}/json", f"{folder}/state", available_now=True).awaitTermination()
    before = readers.read_records(spark, f"{folder}/json").count()
    os.remove(flag)
    for _ in range(2):  # the second start finds nothing new
        readers.stream_records_json(stream(), f"{folder}/json", f"{folder}/state", available_now=True).awaitTermination()
        got = readers.read_records(spark, f"{folder}/json").collect()
        assert before < 50 and sorted(r.request for r in got) == sorted(f"r{k}" for k in range(50))
    assert {r.start_ns for r in got} == {1_700_000_000_000_000_000 + k for k in range(10)}


@pytest.mark.parametrize("kind", ["parquet", "json", "orc"])
def test_event_families_as_streams(spark, kind):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in range(3):
        spark.createDataFrame([(part, 2, part, 5, 100 + part, 0, 0, "eth0")], FAMILIES["kern"]).coalesce(1).write.mode("append").format(kind).save(f"{folder}/kern")
    seen = []
    for _ in range(2):
        q = readers.for_each_batch(readers.read_events(spark, f"{folder}/kern", "kern", streaming=True, kind=kind, maxFilesPerTrigger="1"), lambda b, n: seen.append((n, b.select("ts_ns").first()[0])), f"{folder}/state", available_now=True)
        q.awaitTermination()
    assert sorted(t for _, t in seen) == [100, 101, 102] and len({n for n, _ in seen}) == 3
    with pytest.raises(ValueError, match="no event family"):
        readers.read_events(spark, folder, "nothing")
