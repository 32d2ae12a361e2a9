"""Byte streams from captured segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.operators import scan

c = F.col

#: A gap or a fall of this many bytes begins a new epoch of a stream.
MIB = 1 << 20
WRAP = 1 << 31


def unwrapped(segments: DataFrame, keys: tuple[str, ...] = ("conn_id", "direction")) -> DataFrame:
    """segments with seq64: the 32-bit sequence number without wraps, following the order of arrival."""
    w = Window.partitionBy(*keys).orderBy("arrival")
    fall = F.lag("seq").over(w) - c("seq")
    step = F.when(fall > WRAP, 1).when(fall < -WRAP, -1).otherwise(0)
    rows = segments.withColumn("_step", step)
    return rows.withColumn("seq64", c("seq") + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.lit(1 << 32)).drop("_step")


def wrapped_islands(segments: DataFrame, keys: tuple[str, ...] = ("conn_id", "direction")) -> DataFrame:
    """islands() of streams whose 32-bit seq may wrap: a wrap begins a new epoch, too, and start and end are those of the 32-bit
    numbers. Epochs and islands of a stream are numbered through all its wraps."""
    rows = unwrapped(segments, keys).withColumn("_wrap", F.floor(c("seq64") / F.lit(1 << 32)).cast("long"))
    out = islands(rows, (*keys, "_wrap"))
    order = Window.partitionBy(*keys)
    return out.withColumns({"epoch": (F.dense_rank().over(order.orderBy("_wrap", "epoch")) - 1).cast("long"), "island": F.row_number().over(order.orderBy("_wrap", "island")).cast("long")}).drop("_wrap")


def islands(segments: DataFrame, keys: tuple[str, ...] = ("conn_id", "direction"), blocks: int | None = None) -> DataFrame:
    """Fused ranges of each stream: (keys, epoch, island, start, end, segments, bytes).

    Of segments at one seq the first to arrive counts; overlapping and adjacent ranges are fused, a gap leaves two ranges, and
    a gap of MIB or more begins a new epoch. seq must not wrap (wrapped_islands() takes such streams). Gaps and islands by windows, of long
    streams in `blocks` (scan.running).
    """
    first = segments.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "seq").orderBy("arrival"))).where("_n = 1").withColumn("_end", c("seq") + c("len"))
    rows = scan.running(first, keys, ["seq"], {"_reach": ("max", c("_end"), False)}, blocks)
    far, apart = (c("seq") - c("_reach") >= MIB).cast("int"), (c("seq") > c("_reach")).cast("int")
    rows = scan.running(rows, keys, ["seq"], {"epoch": ("sum", F.coalesce(far, F.lit(0)), True), "island": ("sum", F.coalesce(apart, F.lit(1)), True)}, blocks)
    return rows.groupBy(*keys, "epoch", "island").agg(F.min("seq").alias("start"), F.max("_end").alias("end"), F.count(F.lit(1)).alias("segments"), F.sum("len").alias("bytes"))


def reassemble(segments: DataFrame, keys: tuple[str, ...] = ("conn_id", "direction"), block: int | None = None, parts: int | None = None) -> DataFrame:
    """Fused ranges with their payload: (keys, start, payload). Every byte is that of the segment that arrived first.

    Each segment is cut at the borders of the others it meets, and of the pieces at one place the earliest arrival is kept; so
    data that come late and overlap what is there lose the overlap, on either side and in the middle. Cuts are made inside a fused
    range only, and without payloads: those are joined once to the pieces that are kept. With `block` a range comes in rows of
    so many bytes at most, begun at multiples of it, and no row holds more of a long stream than that. `parts` is the number of
    partitions of its joins, which should grow with the rows (scratch.parts_of), as a task's memory does otherwise; else the session's.
    """
    dealt = lambda rows, *by: rows.repartition(parts, *by) if parts else rows
    ends = segments.withColumn("_end", c("seq") + F.octet_length("payload"))
    first = ends.where("_end > seq").groupBy(*keys, "seq").agg(F.min_by(F.struct("arrival", "_end"), "arrival").alias("_f")).select(*keys, "seq", "_f.arrival", "_f._end")
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = first.withColumn("_reach", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_island", F.sum(F.coalesce((c("seq") > c("_reach")).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    group = [*keys, "_island"]
    borders = rows.select(*group, F.explode(F.array("seq", "_end")).alias("lo")).distinct()
    borders = borders.withColumn("hi", F.lead("lo").over(Window.partitionBy(*group).orderBy("lo"))).where("hi is not null")
    bin_of = lambda x: F.floor(x / F.lit(4096))
    in_bins, places = rows.withColumn("_bin", F.explode(F.sequence(bin_of(c("seq")), bin_of(c("_end") - 1)))), borders.withColumn("_bin", bin_of(c("lo")))
    pieces = dealt(in_bins, *group, "_bin").join(dealt(places, *group, "_bin"), [*group, "_bin"]).where("lo >= seq and hi <= _end")
    best = pieces.groupBy(*group, "_bin", "lo", "hi").agg(F.min_by("seq", "arrival").alias("_seq"), F.min("arrival").alias("_arrival")).drop("_bin")
    if block:
        best = best.withColumn("_b", F.explode(F.sequence(F.floor(c("lo") / block), F.floor((c("hi") - 1) / block)))).withColumns({"lo": F.greatest("lo", c("_b") * block), "hi": F.least("hi", (c("_b") + 1) * block)})
        group = [*group, "_b"]
    held = segments.select(*keys, c("seq").alias("_seq"), c("arrival").alias("_arrival"), "payload")
    source = [*keys, "_seq", "_arrival"]
    piece = dealt(best, *source).join(dealt(held, *source), source).select(*group, "lo", F.substring(c("payload"), (c("lo") - c("_seq") + 1).cast("int"), (c("hi") - c("lo")).cast("int")).alias("bytes"))
    return dealt(piece, *group).groupBy(*group).agg(F.min("lo").alias("start"), F.expr("listagg(bytes) WITHIN GROUP (ORDER BY lo)").alias("payload")).select(*keys, "start", "payload")
