"""What the operators of this subpackage share: scratch tables, connected components, a fixed-size filter."""

from __future__ import annotations

import ctypes
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as contracts write it: [\x20\x09-\x0D].
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in spark.checkpoint.dir; on a local master it may be the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/netlens-{spark.sparkContext.applicationId}"


_SCOPE = ""
#: Spark's switch that deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "table", scoped: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of executors. The shuffle files behind it go once
    it is written, not when the driver happens to collect its garbage, so that disk holds those of one step at a time."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{_SCOPE if scoped else ''}{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more: what was made of it is written."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def begin_scope(spark: SparkSession, name: str) -> None:
    """From now on scratch tables are written under `name`; what a scope of this name held before is deleted. For steps whose
    results are written before the next one begins, like those of a pipeline."""
    global _SCOPE
    drop_scratch(spark, name)
    _SCOPE = f"{name}/"


def end_scope() -> None:
    global _SCOPE
    _SCOPE = ""


def drop_scratch(spark: SparkSession, scope: str = "") -> None:
    """Delete this application's scratch tables, or those of a scope; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{scope}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run):
    """A task's function of batches that, at its end, gives freed memory back to the system: a Python worker waits for its next task with
    what its allocators hold, beside the executor's own memory."""

    @wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library has no such call
            pass

    return tidied


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(batches):
    """Edges of one partition to a star from each node to the smallest one it reaches there."""
    ids: dict[int, int] = {}
    names: list[int] = []
    parent: list[int] = []
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            pair = []
            for x in (u, v):
                k = ids.get(x)
                if k is None:
                    k = ids[x] = len(names)
                    names.append(x)
                    parent.append(k)
                pair.append(find(parent, k))
            a, c = pair
            if a != c:
                if names[a] < names[c]:
                    parent[c] = a
                else:
                    parent[a] = c
    u, v = [], []
    for k, x in enumerate(names):
        r = find(parent, k)
        if r != k:
            u.append(x)
            v.append(names[r])
        if len(u) >= 65536:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


#: Edges that one task folds at once: the end of every run, and all of a small one.
FOLD = 1 << 18


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges(u long, v long) by alternating large-star and small-star rounds.

    Returns (node, root) for every node that has an edge to a smaller node of its component; root is the smallest node
    of the component, and a node that is its own root has no row. Each partition first folds its edges into stars.
    A hub is never gathered: minima are partial aggregates and the joins on the node can be split where they are skewed.
    Rounds are written to the shared folder; their number grows with the logarithm of the longest chain. Once no more than
    FOLD edges are left, one task folds them to the end, which gives what further rounds would give.
    """
    e = materialise(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
                    .where("u <> v").mapInArrow(_forest, "u long, v long"), "edges")
    seen = None
    for _ in range(max_rounds):
        if e.limit(FOLD + 1).count() <= FOLD:
            folded = materialise(e.coalesce(1).mapInArrow(_forest, "u long, v long"), "edges")
            return folded.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge of large points from a greater node (u) to a smaller one (v)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def bit_filter(keys: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """2**bits bits (8 MB for 26, whatever the number of keys) where the bucket of each key's value is set.

    A filter that lets some other keys through, never one that stops a key: joins stay exact behind it. It is built by
    a partial aggregate over 64-bit words, and what the driver gets is bounded by 2**bits / 8 bytes.
    """
    bucket = F.shiftrightunsigned(F.col(column).cast("long"), 64 - bits)
    words = (keys.where(F.col(column).isNotNull()).select(F.shiftright(bucket, 6).alias("w"), bucket.bitwiseAND(F.lit(63)).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("x")))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("x").to_numpy().view(np.uint64)
    return out


def may_hold(filter_words: np.ndarray, keys: np.ndarray, bits: int = 26) -> np.ndarray:
    """For 64-bit keys (any integer dtype): whether bit_filter() may have had them."""
    bucket = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (filter_words[bucket >> np.uint64(6)] >> (bucket & np.uint64(63))) & np.uint64(1) != 0
