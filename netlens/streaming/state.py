"""What stateful operators share: the RocksDB store, parts of keys, an entry for each key and one timer for each part."""

from __future__ import annotations

import itertools
import json
import pickle
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which transformWithState needs: state beyond memory, and checkpoints
    of changes only."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


#: Parts by hash that the keys of a stream are dealt to. A part has one state and one call for all of its keys: a call for each key costs
#: about a millisecond, whatever is in it. The number is part of a checkpoint.
LANES = 512
_LANE = "_lane"


def dealt(rows: DataFrame, keys: tuple[str, ...], lanes: int):
    return rows.withColumn(_LANE, F.pmod(F.xxhash64(*keys), F.lit(lanes))).groupBy(_LANE)


class Replaying(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them, and are then replayed in order of event time, whatever batches they
    came in; between them and after the last one, replay() may let time pass. Keys of one part (see dealt()) share a call and a timer, as
    each call and each access to a state costs milliseconds whatever is in it. A part has one value: an entry for each key, of its waiting
    rows and what close_call() gives. Subclasses give:

    KEYS      names of the key columns
    HELD      names of what is held of a row; the first is its time in nanoseconds, and rows are replayed in order of all fields
    open()    what a key starts with: what close_call() gave, or None
    replay()  one row; returns output rows
    pass_time() what is due before a time; returns output rows
    close_call() what to keep of the key, None if nothing, and the next time in nanoseconds at which something is due, or None
    """

    KEYS: tuple[str, ...]
    HELD: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.part = handle.getValueState("part", "at_ms long, entries binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = defaultdict(list)
        for pdf in rows:
            for k, held in zip(pdf["key"], pdf["held"], strict=True):
                new[k].append(tuple(map(json.loads(held).get, self.HELD)))
        return self._told(new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._told({}, timerValues)

    def _told(self, new, timerValues) -> Iterator[pd.DataFrame]:
        for some in itertools.batched(self._call(new, timerValues.getCurrentWatermarkInMs()), 10_000):
            yield pd.DataFrame({"made": [json.dumps(x) for x in some]})

    def _call(self, new: dict[str, list[tuple]], watermark_ms: int) -> Iterator[dict]:
        old = self.part.get()
        # of each key when something is due (None: never) and what is held; only entries that are called for are unpacked
        timer, entries = (old[0], pickle.loads(old[1])) if old else (None, {})
        limit = watermark_ms * 1_000_000
        for name in [*new, *(k for k, (wake, _) in entries.items() if k not in new and wake is not None and wake <= limit)]:
            before, was = pickle.loads(entries[name][1]) if name in entries else ([], None)
            key = tuple(map(json.loads(name).get, self.KEYS))
            held = sorted(before + new.pop(name, []), key=lambda r: tuple((x is not None, x) for x in r))
            due = sum(r[0] <= limit for r in held)
            self.open(key, was)
            for r in held[:due]:
                yield from self.pass_time(key, r[0])
                yield from self.replay(key, r)
            yield from self.pass_time(key, limit)
            kept, wake = self.close_call()
            rest = held[due:]
            if rest:
                wake = rest[0][0] if wake is None else min(wake, rest[0][0])
            if rest or kept is not None:
                entries[name] = wake, pickle.dumps((rest, kept), -1)
            else:
                entries.pop(name, None)
        at = self._wake(timer, min((wake for wake, _ in entries.values() if wake is not None), default=None), watermark_ms)
        if entries:
            self.part.update((at, pickle.dumps(entries, -1)))
        elif old:
            self.part.clear()

    def _wake(self, old: int | None, wake_ns: int | None, watermark_ms: int) -> int | None:
        at = None if wake_ns is None else max(-(-wake_ns // 1_000_000), watermark_ms + 1)
        if old is not None and old != at and old > watermark_ms:
            self.handle.deleteTimer(old)
        if at is not None and old != at:
            self.handle.registerTimer(at)
        return at

    def close(self) -> None:
        pass


def replayed(rows: DataFrame, processor: Replaying, made: str, lanes: int) -> DataFrame:
    """What a processor makes (DDL `made`) of rows with `at`, its keys and what it holds, in `lanes` parts by hash of the keys. Rows come to
    Python and leave it as one JSON text each: nulls and longs stay exact, and Spark hands rows over column by column, which costs
    most of the time where columns are many."""
    packed = rows.select("at", F.to_json(F.struct(*processor.KEYS)).alias("key"), F.to_json(F.struct(*processor.HELD)).alias("held"))
    out = dealt(packed, ("key",), lanes).transformWithStateInPandas(processor, "made string", "append", "EventTime")
    return out.select(F.from_json("made", made).alias("_made")).select("_made.*")
