"""Joins of byte ranges: packets to messages, encrypted to plain, offsets to times. Equi-joins on bins, never nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.operators import scan

c = F.col

#: Share of the longest rows that may have bins of their own; how many powers of two longer than the others they are then; and how far
#: those bins' sizes are apart.
LONG_SHARE, SPARE, STEP = 0.01, 3, 4


def _level(size):
    """The power of two that a length does not exceed."""
    return F.greatest(F.ceil(F.log2(size.cast("double"))), F.lit(0)).cast("int")


def _size_classes(e: DataFrame, r: DataFrame) -> tuple[int, list[int], list[int]]:
    """(usual, classes of e, classes of r): bin sizes as powers of two, from one count by side and length's power, 128 numbers at most.
    Up to `usual` all have the same bins: SPARE above the least size that all but LONG_SHARE of the rows keep to, or what is longest."""
    sides = e.select(F.lit(0).alias("side"), _level(c("len")).alias("level")).unionAll(r.select(F.lit(1).alias("side"), _level(c("end") - c("start")).alias("level")))
    counts = {(x.side, x.level): x["count"] for x in sides.groupBy("side", "level").count().collect()}
    total, longer, usual = sum(counts.values()), 0, 0
    for level in sorted({level for _, level in counts}, reverse=True):
        longer += sum(counts.get((side, level), 0) for side in (0, 1))
        if longer > LONG_SHARE * total:
            usual = min(level + SPARE, max(k for _, k in counts))
            break
    return usual, *(sorted({usual + max(0, -(-(level - usual) // STEP)) * STEP for side, level in counts if side == which}) for which in (0, 1))


def _in_bins(rows: DataFrame, first, last, size) -> DataFrame:
    low, high = (F.call_function("shiftright", x, size) for x in (first, last))
    return rows.withColumn("_bin", F.explode(F.when(low == high, F.array(low)).otherwise(F.sequence(low, high))))


def _binned(rows: DataFrame, size, first, last, usual: int, others: list[int]) -> DataFrame:
    """rows in the bins of their own class and of every greater class of the other side: one or two bins in each."""
    level = _level(size)
    own = F.when(level <= usual, F.lit(usual)).otherwise(F.lit(usual) + F.ceil((level - usual) / STEP).cast("int") * STEP)
    rows = rows.withColumn("_own", own)
    rows = rows.withColumn("_class", F.explode(F.array_distinct(F.concat(F.array("_own"), F.filter(F.array(*map(F.lit, others)), lambda x: x > c("_own"))))))
    return _in_bins(rows, first, last, c("_class"))


def overlap_join(events: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("conn_id",)) -> DataFrame:
    """Every event [seq, seq + len) with every range [start, end) of the same keys that it overlaps; each pair once.

    An equi-join on bins. A count of lengths comes first (a job over both sides, whose result is 128 numbers at most): bins have the
    size that nearly all rows keep to; longer rows have bins of their own size class, and rows of the other side are put into
    those, too. So no row is in more than two bins of a class, however long it is, and there are few classes. A pair is kept in
    the class of the longer one, in the bin where the later of the two begins: no distinct is needed. Ranges of no bytes overlap
    nothing.
    """
    e, r = events.where("len > 0"), ranges.where("end > start")
    usual, of_e, of_r = _size_classes(e, r)
    hit, last_e, last_r = (c("seq") < c("end")) & (c("seq") + c("len") > c("start")), c("seq") + c("len") - 1, c("end") - 1
    if {*of_e, *of_r} <= {usual}:
        size = F.lit(usual)
        both = _in_bins(e, c("seq"), last_e, size).join(_in_bins(r, c("start"), last_r, size), [*keys, "_bin"])
        return both.where(hit & (c("_bin") == F.call_function("shiftright", F.greatest("seq", "start"), size))).drop("_bin")
    both = _binned(e, c("len"), c("seq"), last_e, usual, of_r).withColumnRenamed("_own", "_e").join(_binned(r, c("end") - c("start"), c("start"), last_r, usual, of_e).withColumnRenamed("_own", "_r"), [*keys, "_class", "_bin"])
    hit = hit & (c("_class") == F.greatest("_e", "_r"))
    return both.where(hit & (c("_bin") == F.call_function("shiftright", F.greatest("seq", "start"), c("_class")))).drop("_bin", "_class", "_e", "_r")


def map_tls(ssl_events: DataFrame, messages: DataFrame, keys: tuple[str, ...] = ("conn_id",)) -> DataFrame:
    """The kernel byte range under each plain message: from the first known kernel start to the end of the last event; invalid (valid =
    false) if an event of the message has no kernel length. ssl_events(seq, len, syscall_seq, syscall_len)."""
    inside = overlap_join(ssl_events, messages, keys).where("seq >= start")
    start = F.min_by(F.when(c("syscall_seq") > 0, c("syscall_seq")), F.when(c("syscall_seq") > 0, c("seq")))
    end = F.max_by(c("syscall_seq") + c("syscall_len"), c("seq"))
    return inside.groupBy(*keys, "start", "end").agg(start.alias("kern_start"), (end - start).alias("kern_len"), F.bool_and(c("syscall_len") > 0).alias("valid"))


def time_of_offset(offsets: DataFrame, segments: DataFrame, keys: tuple[str, ...] = ("conn_id",), blocks: int | None = None) -> DataFrame:
    """offsets(keys, seq, ...) with ts_ns: the time of the segment with the greatest seq that is not beyond the offset; of segments at one
    seq the first that came counts."""
    s = segments.groupBy(*keys, "seq").agg(F.min_by("ts_ns", "arrival").alias("_ts"))
    both = offsets.withColumn("_q", F.lit(1)).unionByName(s.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    return scan.running(both, keys, ["seq", "_q"], {"ts_ns": ("last", c("_ts"), True)}, blocks).where("_q = 1").drop("_q", "_ts")
