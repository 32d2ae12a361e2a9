"""Records of a stream in the order of their requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.operators.scan import running
from netlens.operators.scratch import parts_of, written
from netlens.streaming.run import Numbered, event_time

_COPIES = "_copies"


def in_request_order(records: DataFrame, columns: list[str], ts: str = "start_ns", lane: str | None = None, lanes: int = 8, delay: str = "1 second") -> Numbered:
    """Records (ts and `columns`) with lane and position: of each lane they leave in order of ts and then of `columns`, numbered through from
    0, whatever order and batches they came in. run.run_available() runs it.

    A lane is what a `lane` column says, or one of `lanes` parts by hash of the first column; order holds inside a lane. Records are held
    until the watermark passes them, so for `delay` of event time, the time in which they settle: with a delay as long as the
    longest request, none that was begun earlier comes later. State is what waits, one key for each different record, so it is
    spread over all tasks and no lane is held by one; what a batch lets go is sorted in ranges and numbered after what left before
    it. `columns` have types that can be grouped by.
    """
    key = F.col(lane).cast("long") if lane else F.pmod(F.xxhash64(columns[0]), F.lit(lanes))
    rows = records.withColumn("at", event_time(ts)).withWatermark("at", delay).select("at", key.alias("lane"), ts, *columns)
    held = rows.groupBy("at", "lane", ts, *columns).agg(F.count(F.lit(1)).alias(_COPIES))
    return Numbered(held.select("lane", ts, *columns, _COPIES), numbered)


def numbered(batch: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of a batch with their positions, how many rows each lane has in it), after those of the batches before: (lane, n) of each."""
    batch = written(batch, "let_go")
    names = [n for n in batch.columns if n not in ("lane", _COPIES)]
    # lanes may be null, keys of a scan may not
    rows = batch.withColumns({"_lane": F.coalesce("lane", F.lit(0)), "_none": F.col("lane").isNull()})
    rows = running(rows, ["_lane", "_none"], names, {"_first": ("sum", F.col(_COPIES), False)}, blocks=parts_of(batch))
    past = before.groupBy("lane").agg(F.sum("n").alias("_past")).withColumnRenamed("lane", "_of")
    rows = rows.join(F.broadcast(past), F.col("lane").eqNullSafe(F.col("_of")), "left")
    first = F.coalesce("_past", F.lit(0)) + F.coalesce("_first", F.lit(0))
    copies = F.sequence(F.lit(0).cast("long"), F.col(_COPIES) - 1)
    rows = rows.select("lane", first.alias("_at"), *names, F.explode(copies).alias("_copy"))
    return rows.select("lane", (F.col("_at") + F.col("_copy")).alias("position"), *names), batch.groupBy("lane").agg(F.sum(_COPIES).alias("n"))
